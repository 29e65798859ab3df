"""Queries on news: alignment, daily features, impact, statistics."""

from pyspark.sql import functions as F

from tickerloom.functions import timing
from tickerloom.functions.maths import json_list_decode, set_ops
from tickerloom.operators import calendar as cal, impact, news as nw, news_daily as nd, panel
from tickerloom.operators.ordered import materialize
from tickerloom.plans import fixtures as fx
from tickerloom.plans.market_queries import fold
from tickerloom.plans.registry import cte, query

KEY = "stock_code, trade_date"
TS = f"TIMESTAMP '{fx.AS_OF}'"


@query("c2_align_news", "SELECT news_id, stock_code, trade_date FROM fx_aligned", t="trade_date")
def c2(spark, sf):
    return fx.aligned(spark, sf).select("news_id", "stock_code", "trade_date")


@query(
    "c3_neighbour_trade_date",
    """SELECT news_id, stock_code, n.trade_date AS next_date, p.trade_date AS prev_date FROM
    (SELECT news_id, stock_code, CAST(publish_time AS DATE) AS day FROM fx_news) a
    ASOF LEFT JOIN (SELECT stock_code AS s1, trade_date FROM fx_cal) n ON a.stock_code = n.s1 AND a.day < n.trade_date
    ASOF LEFT JOIN (SELECT stock_code AS s2, trade_date FROM fx_cal) p ON a.stock_code = p.s2 AND a.day >= p.trade_date""",
    t="next_date prev_date",
)
def c3(spark, sf):
    days = fx.news(spark, sf).select("news_id", "stock_code", F.to_date("publish_time").alias("day"))
    c = fx.calendar(spark, sf)
    out = cal.neighbour_trade_date(days, c, "next").withColumnRenamed("neighbour", "next_date")
    out = cal.neighbour_trade_date(out, c, "previous", include_current=True).withColumnRenamed("neighbour", "prev_date")
    return out.select("news_id", "stock_code", "next_date", "prev_date")


HOURS = f"((epoch_us({TS}) - epoch_us(publish_time)) / 3.6e9)"


@query(
    "b_time",
    f"""SELECT news_id, strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(close_ts, '%Y-%m-%d %H:%M:%S') AS close_ts, w AS decay_dataset,
    greatest(0.1::DOUBLE, least(1.0::DOUBLE, exp(-{HOURS} * ln(2) / 24))) AS decay_impact, 1e3 * exp(-{HOURS} / 24) AS decay_encode,
    CAST(date_diff('day', DATE '2000-01-01', trade_date) AS DOUBLE) AS listing_days,
    strftime(time_bucket(INTERVAL 30 MINUTE, publish_time), '%Y-%m-%d %H:%M:%S') AS bucket FROM fx_aligned""",
    d="decay_dataset decay_impact decay_encode listing_days",
)
def b_time(spark, sf):
    """B20, B21, B23-B27, one column each."""
    a = fx.aligned(spark, sf)
    ts, close = F.col("publish_time"), timing.trade_close_ts(F.col("trade_date"))
    return a.select(
        "news_id",
        timing.parse_timestamp(F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).alias("parsed"),
        close.alias("close_ts"),
        timing.decay_dataset(ts, close).alias("decay_dataset"),
        timing.decay_impact(ts, fx.as_of()).alias("decay_impact"),
        (1e3 * timing.decay_encode(ts, fx.as_of())).alias("decay_encode"),
        timing.listing_days(F.col("trade_date"), F.lit("2000-01-01").cast("date")).alias("listing_days"),
        timing.bucket_30m(ts).alias("bucket"),
    )


@query("b22_freshness_filter", f"SELECT news_id, stock_code FROM fx_news WHERE publish_time >= {TS} - INTERVAL 300 HOUR")
def b22(spark, sf):
    return timing.freshness_filter(fx.news(spark, sf), fx.as_of(), 300).select("news_id", "stock_code")


@query("f2_sort_news", "SELECT news_id, strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time FROM fx_news ORDER BY publish_time DESC, news_id")
def f2(spark, sf):
    return nw.sort_news(fx.news(spark, sf).select("news_id", "publish_time"))


cte(
    "nd_base",
    """SELECT stock_code, trade_date, count(*) AS news_count, avg(sentiment) AS avg_sentiment, sum(sentiment * w) / sum(w) AS weighted_sentiment,
    avg(importance) AS avg_importance, max(importance) AS max_importance,
    avg(CASE WHEN sentiment > 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive_ratio,
    avg(CASE WHEN sentiment < -0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS negative_ratio,
    sum(abs(sentiment)) AS news_sentiment_abs_sum, count(DISTINCT source) AS source_count,
    """
    + ", ".join(f"sum(CASE WHEN contains(title || ' ' || content, '{k}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS event_{v}_count" for k, v in fx.EVENTS.items())
    + " FROM fx_aligned GROUP BY 1, 2",
)
cte(
    "nd_entropy",
    """SELECT stock_code, trade_date, -sum(n / t * ln(n / t + 1e-12)) / CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1.0::DOUBLE END AS source_entropy
    FROM (SELECT stock_code, trade_date, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY stock_code, trade_date) AS t FROM fx_aligned GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
cte(
    "nd_sector0",
    "SELECT stock_code, trade_date, sector, sum(sw * sentiment * importance * w) AS v FROM fx_aligned GROUP BY 1, 2, 3",
)
SECTOR_COLS = [f"sector_{v}" for v in fx.SECTORS.values()]
cte(
    "nd_sector",
    "SELECT stock_code, trade_date, sum(v) AS news_impact_total, sum(abs(v)) AS news_impact_abs_total, "
    + ", ".join(f"sum(CASE WHEN sector = '{k}' THEN v ELSE 0 END) AS sector_{v}" for k, v in fx.SECTORS.items())
    + " FROM nd_sector0 GROUP BY 1, 2",
)
EVENT_COLS = [f"event_{v}_count" for v in fx.EVENTS.values()]
BASE = ["avg_sentiment", "weighted_sentiment", "avg_importance", "max_importance", "positive_ratio", "negative_ratio", "news_sentiment_abs_sum"]
IMPACT = ["news_impact_total", "news_impact_abs_total"]
zero = lambda cols: ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in cols)
cte(
    "nd_daily0",
    f"""SELECT c.stock_code, c.trade_date, coalesce(news_count, 0) AS news_count, {zero(BASE + EVENT_COLS + SECTOR_COLS + IMPACT)},
    coalesce(CAST(source_count AS DOUBLE), 0.0::DOUBLE) AS source_count, coalesce(source_entropy, 0.0::DOUBLE) AS source_entropy
    FROM fx_cal c LEFT JOIN nd_base USING (stock_code, trade_date) LEFT JOIN nd_entropy USING (stock_code, trade_date) LEFT JOIN nd_sector USING (stock_code, trade_date)""",
)
cte(
    "nd_daily1",
    """SELECT *, CASE WHEN news_count >= 8 OR abs(weighted_sentiment) >= 0.45 OR news_impact_abs_total >= 1.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_shock_flag FROM nd_daily0""",
)
EWM = ["sentiment_ewm_3d", "sentiment_ewm_5d", "importance_ewm_3d", "importance_ewm_5d", "news_count_ewm_5d", "impact_ewm_5d"]
cte(
    "nd_daily",
    f"""SELECT *, {fold('weighted_sentiment', 3)} AS sentiment_ewm_3d, {fold('weighted_sentiment', 5)} AS sentiment_ewm_5d,
    {fold('avg_importance', 3)} AS importance_ewm_3d, {fold('avg_importance', 5)} AS importance_ewm_5d,
    {fold('CAST(news_count AS DOUBLE)', 5)} AS news_count_ewm_5d, {fold('news_impact_total', 5)} AS impact_ewm_5d FROM nd_daily1""",
)


def daily(spark, sf, days=None):
    """All daily features; the calendar is written once, for the alignment and for the days without news."""
    days = materialize(fx.calendar(spark, sf), "calendar") if days is None else days
    return nd.news_daily_features(fx.aligned(spark, sf, days), days, fx.SECTORS, fx.EVENTS)


ALL_DAILY = BASE + ["source_count", "source_entropy"] + SECTOR_COLS + EVENT_COLS + IMPACT + ["event_shock_flag"] + EWM


@query("news_daily_features", f"SELECT {KEY}, news_count, {', '.join(ALL_DAILY)} FROM nd_daily", d=" ".join(ALL_DAILY), i="news_count", t="trade_date")
def q_daily(spark, sf):
    return daily(spark, sf)


@query("d1_news_daily_base", f"SELECT {KEY}, news_count, {', '.join(BASE)} FROM nd_daily0", d=" ".join(BASE), i="news_count", t="trade_date")
def d1(spark, sf):
    return nd.news_daily_base(fx.aligned(spark, sf), fx.calendar(spark, sf))


@query("d2_weighted_sentiment", f"SELECT {KEY}, weighted_sentiment FROM nd_base", d="weighted_sentiment", t="trade_date")
def d2(spark, sf):
    a = fx.aligned(spark, sf)
    return nd.news_daily_base(a, a.select("stock_code", "trade_date").distinct()).select("stock_code", "trade_date", "weighted_sentiment")


@query("d3_d4_source_stats", f"SELECT {KEY}, CAST(source_count AS DOUBLE) AS source_count, source_entropy FROM nd_base JOIN nd_entropy USING (stock_code, trade_date)", d="source_count source_entropy", t="trade_date")
def d34(spark, sf):
    return nd.source_stats(fx.aligned(spark, sf))


@query("d5_sector_scores", f"SELECT {KEY}, {', '.join(SECTOR_COLS + IMPACT)} FROM nd_sector", d=" ".join(SECTOR_COLS + IMPACT), t="trade_date")
def d5(spark, sf):
    return nd.sector_scores(fx.aligned(spark, sf), fx.SECTORS)


@query("d6_event_counts", f"SELECT {KEY}, {', '.join(EVENT_COLS)} FROM nd_base", d=" ".join(EVENT_COLS), t="trade_date")
def d6(spark, sf):
    return nd.event_counts(fx.aligned(spark, sf), fx.EVENTS)


@query("d7_event_shock_flag", f"SELECT {KEY}, event_shock_flag FROM nd_daily1", d="event_shock_flag", t="trade_date")
def d7(spark, sf):
    return daily(spark, sf).select("stock_code", "trade_date", "event_shock_flag")


@query("e11_news_ewm", f"SELECT {KEY}, {', '.join(EWM)} FROM nd_daily", d=" ".join(EWM), t="trade_date")
def e11(spark, sf):
    return daily(spark, sf).select("stock_code", "trade_date", *EWM)


@query(
    "c12_sample_news_window",
    f"""SELECT {KEY}, news_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY stock_code, trade_date ORDER BY publish_time DESC, news_id) AS rank FROM (
    SELECT c.stock_code, c.trade_date, n.news_id, n.publish_time FROM (SELECT *, lag(close_ts) OVER (PARTITION BY stock_code ORDER BY trade_date) AS open_ts FROM fx_cal) c
    JOIN fx_news n ON n.stock_code = c.stock_code AND n.publish_time <= c.close_ts AND (c.open_ts IS NULL OR n.publish_time > c.open_ts)))""",
    i="rank", t="trade_date",
)
def c12(spark, sf):
    c = fx.calendar(spark, sf)
    return cal.sample_news_window(c, c, fx.news(spark, sf)).select("stock_code", "trade_date", "news_id", "rank")


# ---- impact on stocks

cte(
    "im0",
    f"""SELECT n.*, {HOURS.replace('publish_time', 'n.publish_time')} AS h,
    least(1.0::DOUBLE, coalesce(o.weight, b.weight, 0.2::DOUBLE) * sw) AS sector_relevance,
    greatest(0.1::DOUBLE, least(1.0::DOUBLE, exp(-{HOURS.replace('publish_time', 'n.publish_time')} * ln(2) / 24))) AS time_decay
    FROM fx_news n LEFT JOIN fx_weights o ON o.sector = n.sector AND o.stock_code = n.stock_code
    LEFT JOIN fx_weights b ON b.sector = n.sector AND b.stock_code = 'default'""",
)


def _rel(s):
    return f"(SELECT coalesce(max(weight) FILTER (WHERE f.stock_code = st.stock_code), max(weight) FILTER (WHERE f.stock_code = 'default'), 0.2::DOUBLE) FROM fx_weights f WHERE f.sector = '{s}' AND f.stock_code IN (st.stock_code, 'default'))"


def _factor(impact_value, sectors):
    if not sectors:
        return f"{impact_value}::DOUBLE"
    parts = [f"r_{s}" for s in sectors]
    return f"{impact_value}::DOUBLE * " + (f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0])


NAMED = sorted({s for _, _, _, ss in fx.EVENT_FACTORS for s in ss})
cte(
    "im_rel",
    "SELECT st.stock_code, "
    + ", ".join(f"coalesce(max(CASE WHEN f.sector = '{s}' AND f.stock_code = st.stock_code THEN weight END), max(CASE WHEN f.sector = '{s}' AND f.stock_code = 'default' THEN weight END), 0.2::DOUBLE) AS r_{s}" for s in NAMED)
    + " FROM (SELECT DISTINCT stock_code FROM fx_news) st LEFT JOIN fx_weights f ON f.stock_code IN (st.stock_code, 'default') GROUP BY 1",
)
EVENT_SQL = " + ".join(
    f"CASE WHEN contains(title || ' ' || content, '{term}') THEN {_factor(v, ss)} ELSE 0.0::DOUBLE END" for term, v, _, ss in fx.EVENT_FACTORS
)
FIRST_EVENT = "CASE " + " ".join(f"WHEN contains(title, '{term}') THEN {days}" for term, _, days, _ in fx.EVENT_FACTORS) + " ELSE 0 END"
cte("im1", f"SELECT im0.*, {EVENT_SQL} AS event_impact FROM im0 JOIN im_rel USING (stock_code)")
cte("im2", "SELECT *, (sentiment * importance * sector_relevance + event_impact) * time_decay AS raw FROM im1")
cte(
    "im",
    f"""SELECT stock_code, news_id, publish_time, {fx.half_up('raw', 4)} AS impact_score,
    CASE WHEN raw > 0.1 THEN 'positive' WHEN raw < -0.1 THEN 'negative' ELSE 'neutral' END AS impact_direction,
    {fx.half_up('(abs(raw) * 5)', 2)} AS expected_change_pct, {fx.half_up('least(abs(raw) * 2, 1.0::DOUBLE)', 2)} AS confidence,
    {fx.half_up('sector_relevance', 3)} AS sector_relevance, {fx.half_up('time_decay', 3)} AS time_decay,
    least(10, greatest(2 + CASE WHEN importance > 0.8 THEN 3 WHEN importance > 0.6 THEN 2 ELSE 0 END + CASE WHEN abs(raw) > 0.5 THEN 2 ELSE 0 END, {FIRST_EVENT})) AS duration_days FROM im2""",
)


def impacts(spark, sf):
    return impact.news_impact(fx.news(spark, sf), fx.weights(spark, sf), fx.as_of(), fx.EVENT_FACTORS)


@query("c10_sector_relevance", "SELECT stock_code, news_id, sector_relevance FROM im0", d="sector_relevance")
def c10(spark, sf):
    return impact.sector_relevance(fx.news(spark, sf), fx.weights(spark, sf)).select("stock_code", "news_id", "sector_relevance")


@query("c11_event_impact", "SELECT stock_code, news_id, event_impact FROM im1", d="event_impact")
def c11(spark, sf):
    return impact.event_impact(fx.news(spark, sf), fx.weights(spark, sf), fx.EVENT_FACTORS).select("stock_code", "news_id", "event_impact")


@query(
    "b43_b44_news_impact",
    "SELECT stock_code, news_id, impact_score, impact_direction, expected_change_pct, confidence, sector_relevance, time_decay, duration_days FROM im",
    d="impact_score expected_change_pct confidence sector_relevance time_decay", i="duration_days",
)
def b43(spark, sf):
    return impacts(spark, sf).drop("title", "publish_time")


@query("d9_sector_impact_vector", "SELECT stock_code, sector, sum(sw * sentiment * importance * time_decay) AS impact FROM im0 GROUP BY 1, 2", d="impact")
def d9(spark, sf):
    return impact.sector_impact_vector(fx.news(spark, sf), fx.as_of())


cte(
    "im_sum",
    """SELECT stock_code, count(*) AS total_news, CAST(sum(CAST(round(impact_score * 10000) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE AS t, count(*) FILTER (WHERE impact_score > 0.1) AS positive_count,
    count(*) FILTER (WHERE impact_score < -0.1) AS negative_count FROM im GROUP BY 1""",
)
SUMMARY = f"""stock_code, total_news, {fx.half_up('t', 4)} AS total_impact, CASE WHEN t > 0.2 THEN 'positive' WHEN t < -0.2 THEN 'negative' ELSE 'neutral' END AS overall_sentiment,
    positive_count, negative_count, total_news - positive_count - negative_count AS neutral_count, {fx.half_up('(t / total_news)', 4)} AS avg_impact"""


@query("d10_batch_impact_summary", f"SELECT {SUMMARY} FROM im_sum", d="total_impact avg_impact", i="total_news positive_count negative_count neutral_count")
def d10(spark, sf):
    return impact.batch_impact_summary(impacts(spark, sf))


@query(
    "d10_top_impacts",
    "SELECT stock_code, news_id, impact_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY abs(impact_score) DESC, news_id) AS rank FROM im) WHERE rank <= 20",
    d="impact_score", i="rank",
)
def d10_top(spark, sf):
    return impact.top_impacts(impacts(spark, sf)).select("stock_code", "news_id", "impact_score", "rank")


@query(
    "d10_first_impacts",
    """SELECT stock_code, side, news_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY stock_code, side ORDER BY publish_time, news_id) AS rank FROM (
    SELECT *, CASE WHEN impact_score > 0.1 THEN 'positive' WHEN impact_score < -0.1 THEN 'negative' END AS side FROM im) WHERE side IS NOT NULL) WHERE rank <= 3""",
    i="rank",
)
def d10_first(spark, sf):
    return impact.first_impacts(impacts(spark, sf)).select("stock_code", "side", "news_id", "rank")


cte(
    "im_trend",
    """SELECT stock_code, coalesce(sum(u) FILTER (WHERE r <= n // 2), 0) AS recent, coalesce(sum(u) FILTER (WHERE r > n // 2), 0) AS older, max(n) AS n FROM (
    SELECT *, CAST(round(impact_score * 10000) AS BIGINT) AS u, row_number() OVER (PARTITION BY stock_code ORDER BY publish_time DESC, news_id) AS r, count(*) OVER (PARTITION BY stock_code) AS n FROM im) GROUP BY 1""",
)
TREND = "CASE WHEN n < 2 THEN 'stable' WHEN recent > older + 2000 THEN 'improving' WHEN recent < older - 2000 THEN 'deteriorating' ELSE 'stable' END"


@query("d12_impact_trend", f"SELECT stock_code, {TREND} AS trend, CAST(recent AS DOUBLE) / 10000 AS recent_impact, CAST(older AS DOUBLE) / 10000 AS older_impact FROM im_trend", d="recent_impact older_impact")
def d12(spark, sf):
    return impact.impact_trend(impacts(spark, sf))


@query(
    "d11_impact_report",
    f"""SELECT s.*, {TREND} AS trend, b.bad AS bad_sectors FROM (SELECT {SUMMARY} FROM im_sum) s JOIN im_trend USING (stock_code) LEFT JOIN (
    SELECT stock_code, string_agg(sector, ', ' ORDER BY abs(v) DESC, sector) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY abs(v) DESC, sector) AS r FROM (
    SELECT stock_code, sector, sum(sw * sentiment * importance * time_decay) AS v FROM im0 GROUP BY 1, 2) WHERE v < -0.3) WHERE r <= 3 GROUP BY 1) b USING (stock_code)""",
    d="total_impact avg_impact", i="total_news positive_count negative_count neutral_count",
)
def d11(spark, sf):
    r = impact.impact_report(fx.news(spark, sf), fx.weights(spark, sf), fx.as_of(), fx.EVENT_FACTORS)
    bad = F.get(F.filter("risk_warnings", lambda w: w.startswith("以下领域")), 0)
    return r.withColumn("bad_sectors", F.regexp_extract(bad, r": (.*)$", 1)).drop(
        "sector_impact", "top_impacts", "risk_warnings", "recommendation"
    )


@query(
    "d8_news_statistics",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE sentiment > 0.2) AS positive, count(*) FILTER (WHERE sentiment < -0.2) AS negative,
    {fx.half_up('avg(sentiment)', 3)} AS avg_sentiment, {fx.half_up('avg(importance)', 2)} AS avg_importance,
    count(*) FILTER (WHERE sentiment BETWEEN -0.2 AND 0.2) AS neutral FROM fx_news""",
    d="avg_sentiment avg_importance", i="total positive negative neutral",
)
def d8(spark, sf):
    return nw.news_statistics(fx.news(spark, sf))


@query(
    "d8_news_distributions",
    """SELECT 'source' AS kind, source AS name, count(*) AS n FROM fx_news GROUP BY 2
    UNION ALL (SELECT 'sector', sector, count(*) AS n FROM fx_news GROUP BY 2 ORDER BY n DESC, sector LIMIT 10)""",
    i="n",
)
def d8b(spark, sf):
    return nw.news_distributions(fx.news(spark, sf))


@query(
    "a10_build_news_raw",
    """SELECT stock_code, news_id, strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time, source, title, content, '' AS url,
    '["' || title || '","' || CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END || '"]' AS categories, sentiment, importance,
    '{"' || sector || '":' || CASE WHEN k % 2 = 0 THEN '0.8' ELSE '0.5' END || '}' AS affected_sectors FROM fx_news""",
    d="sentiment importance",
)
def a10(spark, sf):
    return nw.build_news_raw(fx.news(spark, sf).withColumn("url", F.lit(None).cast("string")))


@query(
    "b40_json_list_decode",
    "SELECT news_id, 2 AS n, title AS first FROM fx_news", i="n",
)
def b40(spark, sf):
    raw = nw.build_news_raw(fx.news(spark, sf).withColumn("url", F.lit("")))
    return raw.select("news_id", json_list_decode(F.col("categories")).alias("c")).select("news_id", F.size("c").alias("n"), F.element_at("c", 1).alias("first"))


@query(
    "g6_set_ops",
    """SELECT stock_code, list_aggregate(list_sort(list_intersect(a, b)), 'string_agg', ',') AS both,
    list_aggregate(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), 'string_agg', ',') AS only_a,
    list_aggregate(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), 'string_agg', ',') AS only_b FROM (
    SELECT stock_code, list(DISTINCT sector) FILTER (WHERE sentiment > 0) AS a, list(DISTINCT sector) FILTER (WHERE sentiment <= 0) AS b FROM fx_news GROUP BY 1)
    WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def g6(spark, sf):
    """Sectors of good and of bad news per stock (at most 17 each)."""
    n = fx.news(spark, sf).select("stock_code", "sentiment", F.explode(F.map_keys("affected_sectors")).alias("s"))
    sides = n.groupBy("stock_code").agg(
        F.collect_set(F.when(F.col("sentiment") > 0, F.col("s"))).alias("a"), F.collect_set(F.when(F.col("sentiment") <= 0, F.col("s"))).alias("b")
    ).filter("size(a) > 0 and size(b) > 0")
    o = sides.select("stock_code", set_ops(F.col("a"), F.col("b")).alias("o"))
    text = lambda c: F.nullif(F.array_join(F.col(f"o.{c}"), ","), F.lit("")).alias(c)
    return o.select("stock_code", text("both"), text("only_a"), text("only_b"))


@query("d26_encode_news_features", """SELECT stock_code, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM (
    SELECT stock_code, list_concat([avg(sentiment), stddev_pop(sentiment), avg(importance), least(count(*) / 50, 1.0::DOUBLE),
    avg(CASE WHEN sentiment > 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), avg(CASE WHEN sentiment < -0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
    sum(sentiment * exp(-h / 24)) / sum(exp(-h / 24)), """
    + ", ".join(f"count(*) FILTER (WHERE title = '{c}') / count(*)" for c in ("click", "error", "purchase", "signup", "view"))
    + """, count(*) FILTER (WHERE k % 2 = 0) / count(*)], list_resize([]::DOUBLE[], 51, 0.0::DOUBLE)) AS v FROM im0 GROUP BY 1)""", d="value", i="pos")
def d26(spark, sf):
    from tickerloom.operators.encode import encode_news_features

    v = encode_news_features(fx.news(spark, sf), fx.as_of(), ["click", "error", "purchase", "signup", "view", "even"])
    return v.select("stock_code", F.posexplode("news").alias("pos", "value"))


@query("d29_encode_sector_features", "SELECT stock_code, pos, coalesce(sum(sw * sentiment * importance * time_decay) FILTER (WHERE sector = 'S' || CAST(pos AS VARCHAR)), 0.0::DOUBLE) AS value FROM im0, range(32) t(pos) GROUP BY 1, 2", d="value", i="pos")
def d29(spark, sf):
    from tickerloom.operators.encode import encode_sector_features

    v = encode_sector_features(impact.sector_impact_vector(fx.news(spark, sf), fx.as_of()), list(fx.SECTORS))
    return v.select("stock_code", F.posexplode("sector").alias("pos", "value"))


C17 = """SELECT d.stock_code, x.trade_date, x.news_count, x.event_shock_flag, x.trade_date IS NOT NULL AS available, dates AS available_dates FROM
    (SELECT stock_code, string_agg(strftime(trade_date, '%Y-%m-%d'), ',' ORDER BY trade_date) AS dates FROM (SELECT *, row_number() OVER (ORDER BY trade_date DESC) AS r FROM nd_daily1 WHERE stock_code = '000003') WHERE r <= 60 GROUP BY 1) d
    LEFT JOIN (SELECT * FROM nd_daily1 WHERE stock_code = '000003' AND trade_date = {day}) x USING (stock_code)"""
LOOKED_UP = "stock_code", "trade_date", "news_count", "event_shock_flag", "available"


@query("c17_daily_feature_lookup", C17.format(day="(SELECT max(trade_date) FROM nd_daily1 WHERE stock_code = '000003')"), d="event_shock_flag", i="news_count", t="trade_date")
def c17(spark, sf):
    return panel.daily_feature_lookup(daily(spark, sf), "000003").select(*LOOKED_UP, F.array_join("available_dates", ",").alias("available_dates"))


@query("c17_lookup_of_a_day_without_row", "SELECT stock_code, available, available_dates FROM (" + C17.format(day="DATE '1970-01-05'") + ")")
def c17_none(spark, sf):
    return panel.daily_feature_lookup(daily(spark, sf), "000003", "1970-01-05").select("stock_code", "available", F.array_join("available_dates", ",").alias("available_dates"))
