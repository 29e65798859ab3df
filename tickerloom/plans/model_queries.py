"""Queries on the panel: assembly, splits, metrics, backtest, recommendation, models."""

from pyspark.sql import functions as F

from tickerloom.functions import defaults
from tickerloom.functions.maths import clip, expected_return, return_target, safe_float
from tickerloom.operators import backtest as bt, calendar as cal, metrics, panel, recommend, splits, technical
from tickerloom.operators.ordered import exact_median, materialize
from tickerloom.plans import fixtures as fx
from tickerloom.plans.graph_queries import STATIC_COLS, static
from tickerloom.plans.news_queries import ALL_DAILY, daily
from tickerloom.plans import text_queries  # noqa: F401  (its tables appear in the SQL below)
from tickerloom.plans.registry import CTES, cte, query

KEY = "stock_code, trade_date"
TECH = defaults.TECHNICAL_COLUMNS


def raw_panel(spark, sf):
    """Bars are written once; the calendar of every part is read from them."""
    bars = materialize(fx.market(spark, sf), "bars")
    days = bars.select("stock_code", "trade_date")
    return panel.assemble_panel(technical.technical_panel(bars), daily(spark, sf, days), static(spark, sf, days))


def model_df(spark, sf):
    return panel.finalize_panel(raw_panel(spark, sf))


cte("panel_raw", "SELECT * FROM tech LEFT JOIN nd_daily USING (stock_code, trade_date) LEFT JOIN st_daily USING (stock_code, trade_date)")
NEEDED = " AND ".join(f"{c} IS NOT NULL" for c in TECH + ["future_ret_5d", "label_up_5d"])
cte("panel_model", f"SELECT * REPLACE (CAST(label_up_5d AS INT) AS label_up_5d) FROM panel_raw WHERE {NEEDED}")


@query("c1_assemble_panel", f"SELECT {KEY}, close, ret_5d, news_count, weighted_sentiment, relevance_mean, static_listing_days FROM panel_raw", d="close ret_5d weighted_sentiment relevance_mean static_listing_days", i="news_count", t="trade_date")
def c1(spark, sf):
    return raw_panel(spark, sf).select("stock_code", "trade_date", "close", "ret_5d", "news_count", "weighted_sentiment", "relevance_mean", "static_listing_days")


FINAL = TECH + ALL_DAILY + STATIC_COLS


@query("b49_finalize_panel", f"SELECT {KEY}, label_up_5d, future_ret_5d, news_count, {', '.join(FINAL)} FROM panel_model", d=" ".join(["future_ret_5d", *FINAL]), i="label_up_5d news_count", t="trade_date")
def b49(spark, sf):
    return model_df(spark, sf).select("stock_code", "trade_date", "label_up_5d", "future_ret_5d", "news_count", *FINAL)


GROUPS = {
    "news": [*[c for c in defaults.NEWS_COLUMNS if c in ["news_count", *ALL_DAILY]], *sorted(c for c in ALL_DAILY if c.startswith("event_") and c not in defaults.NEWS_COLUMNS)],
    "sector": sorted(c for c in ALL_DAILY if c.startswith("sector_")),
    "tech": list(TECH),
    "relevance": sorted(c for c in STATIC_COLS if c.startswith(("relevance_", "static_", "stock_sector_"))),
}


@query(
    "b46_b47_feature_groups",
    " UNION ALL ".join(
        f"SELECT '{g}' AS grp, {k} AS pos, '{c}' AS feature, count({c}) AS filled, sum(CAST({c} AS DOUBLE)) AS total FROM panel_model" for g, cols in GROUPS.items() for k, c in enumerate(cols)
    ),
    d="total", i="filled pos",
)
def b46(spark, sf):
    """Every column of every group in its order, with its filled rows and sum over the whole panel."""
    m = model_df(spark, sf)
    listed = [(g, k, c) for g, cols in panel.feature_groups(m).items() for k, c in enumerate(cols)]
    assert {c for *_, c in listed} <= set(panel.select_features(m))
    sums = m.agg(*[F.struct(F.count(c).alias("filled"), F.sum(F.col(c).cast("double")).alias("total")).alias(f"_{i}") for i, (*_, c) in enumerate(listed)])
    rows = [F.struct(F.lit(g).alias("grp"), F.lit(k).alias("pos"), F.lit(c).alias("feature"), F.col(f"_{i}.filled").alias("filled"), F.col(f"_{i}.total").alias("total")) for i, (g, k, c) in enumerate(listed)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("b30_b48_sanitize_features", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 0.0::DOUBLE ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN -1.0::DOUBLE ELSE value END AS s FROM events", d="value s", i="event_id")
def b48(spark, sf):
    e = fx.table(spark, sf, "events")
    k = F.col("event_id") % 4
    dirty = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("value"))
    text = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    d = e.select("event_id", dirty.alias("value"), safe_float(text, -1.0).alias("s"))
    return panel.sanitize_features(d, ["value"])


@query(
    "b54_return_target",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN value > 50 THEN 0.01::DOUBLE ELSE -0.01::DOUBLE END ELSE greatest(-0.35::DOUBLE, least(0.35::DOUBLE, value / 100 - 0.5)) END AS target FROM events",
    d="target", i="event_id",
)
def b54(spark, sf):
    e = fx.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 5 != 0, F.col("value") / 100 - 0.5)
    return e.select("event_id", return_target(raw, (F.col("value") > 50).cast("int")).alias("target"))


@query(
    "b50_expected_return",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN greatest(-35.0::DOUBLE, least(35.0::DOUBLE, (value / 100 - 0.5) * 100)) ELSE
    greatest(-cap, least(cap, tanh((value / 100 - 0.5) * 3.8) * greatest(0.8::DOUBLE, least(12.0::DOUBLE, v * 1.8)))) END AS pct,
    CASE WHEN event_id % 2 = 0 THEN 'regression_head' ELSE 'probability_volatility_fallback' END AS source
    FROM (SELECT *, least(45.0::DOUBLE, greatest(6.0::DOUBLE, v * 2.8)) AS cap FROM (SELECT event_id, value, (user_id % 25)::DOUBLE AS v FROM events))""",
    d="pct", i="event_id",
)
def b50(spark, sf):
    e = fx.table(spark, sf, "events")
    x = F.col("value") / 100 - 0.5
    r = expected_return(F.col("value") / 100, F.when(F.col("event_id") % 2 == 0, x), (F.col("user_id") % 25).cast("double"))
    return e.select("event_id", r.alias("r")).select("event_id", "r.pct", "r.source")


@query(
    "b53_fit_width",
    """SELECT vec_id, w AS width, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM (
    SELECT vec_id, w, list_resize(list_slice(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 1, w), w, 0.0::DOUBLE) AS v FROM embeddings, (VALUES (8), (80)) t(w))""",
    d="value", i="vec_id pos width",
)
def b53(spark, sf):
    """Every whole vector cut to 8 and padded to 80 places."""
    from tickerloom.functions.maths import fit_width

    e = fx.table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    both = [e.select("vec_id", F.lit(w).alias("width"), F.posexplode(fit_width(v, w)).alias("pos", "value")) for w in (8, 80)]
    return both[0].unionByName(both[1])


@query(
    "a3_dataset_manifest",
    """SELECT 'market_daily' AS dataset, count(*) AS rows, count(DISTINCT stock_code) AS stocks, CAST(min(trade_date) AS VARCHAR) AS first_date, CAST(max(trade_date) AS VARCHAR) AS last_date FROM fx_market
    UNION ALL SELECT 'news_raw', count(*), count(DISTINCT stock_code), NULL, NULL FROM fx_news
    UNION ALL SELECT 'news_daily', count(*), count(DISTINCT stock_code), CAST(min(trade_date) AS VARCHAR), CAST(max(trade_date) AS VARCHAR) FROM nd_daily0""",
    i="rows stocks",
)
def a3(spark, sf):
    return panel.dataset_manifest({"market_daily": fx.market(spark, sf), "news_raw": fx.news(spark, sf), "news_daily": daily(spark, sf)})


@query(
    "a18_update_summary",
    """SELECT count(*) AS total_stocks, count(l) AS success_count, count(*) - count(l) AS fail_count, CAST(max(l) AS VARCHAR) AS latest_trade_date,
    (SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT code FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer) WHERE code NOT IN (SELECT stock_code FROM fx_cal) ORDER BY code LIMIT 30)) AS failed_codes_preview
    FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer) LEFT JOIN (SELECT stock_code AS code, max(trade_date) AS l FROM fx_cal GROUP BY 1) USING (code)""",
    i="total_stocks success_count fail_count",
)
def a18(spark, sf):
    """Customers are the stock list; only those numbered like suppliers have bars."""
    listed = fx.table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("stock_code"))
    return panel.update_summary(listed, fx.calendar(spark, sf))


@query("a19_dataset_preview", f"SELECT {KEY}, close FROM fx_market ORDER BY trade_date, stock_code LIMIT 5", d="close", t="trade_date")
def a19(spark, sf):
    return panel.dataset_preview(fx.market(spark, sf).orderBy("trade_date", "stock_code"), 5)


@query(
    "a20_feature_readiness",
    """SELECT 'technical' AS grp, true AS ready, '' AS missing, count(*) AS row_count, least("""
    + ", ".join(f"count({c})" for c in TECH)
    + """) / count(*) AS min_fill FROM tech UNION ALL SELECT 'news', false, 'news_count', count(*), 0.0::DOUBLE FROM tech""",
    d="min_fill", i="row_count",
)
def a20(spark, sf):
    return panel.feature_readiness(technical.technical_panel(fx.market(spark, sf)), {"technical": TECH, "news": ["news_count"]})


cte(
    "rp_used",
    """SELECT stock_code, trade_date, string_agg(strftime(publish_time, '%Y-%m-%d %H:%M:%S') || '|' || source || '|' || title || '|' || CAST(CAST(floor(sentiment * 1000 + 0.5) AS BIGINT) AS VARCHAR)
    || '|' || CAST(CAST(floor(importance * 1000 + 0.5) AS BIGINT) AS VARCHAR), ';' ORDER BY publish_time DESC, news_id) AS news
    FROM (SELECT *, row_number() OVER (PARTITION BY stock_code, trade_date ORDER BY publish_time DESC, news_id) AS r FROM fx_aligned) WHERE r <= 20 GROUP BY 1, 2""",
)
cte(
    "rp_dates",
    """SELECT stock_code, string_agg(strftime(trade_date, '%Y-%m-%d'), ',' ORDER BY trade_date) AS available_dates, max(trade_date) AS last_day
    FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS r FROM fx_cal) WHERE r <= 120 GROUP BY 1""",
)


def used_text():
    """The used items of a sample as one text, numbers in thousandths."""
    mil = lambda x: F.floor(x * 1000 + 0.5).cast("string")
    one = lambda u: F.concat_ws("|", F.date_format(u["publish_time"], "yyyy-MM-dd HH:mm:ss"), u["source"], u["title"], mil(u["sentiment"]), mil(u["importance"]))
    return F.array_join(F.transform("used_news", one), ";").alias("used_news")


@query(
    "c13_replay_of_days",
    """SELECT d.stock_code, d.trade_date, coalesce(news, '') AS used_news, available_dates FROM
    (SELECT DISTINCT stock_code, trade_date FROM fx_aligned WHERE trade_date IN (SELECT max(trade_date) FROM fx_aligned)) d JOIN rp_dates USING (stock_code) LEFT JOIN rp_used USING (stock_code, trade_date)""",
    t="trade_date",
)
def c13_days(spark, sf):
    """The samples of the last day that has news: the items they used and their stocks' last dates."""
    m = fx.market(spark, sf)
    days = materialize(m.select("stock_code", "trade_date"), "calendar")
    items = fx.aligned(spark, sf, days).select("stock_code", "trade_date").distinct()
    keys = items.filter(F.col("trade_date") == items.agg(F.max("trade_date")).scalar())
    r = cal.sample_replay(days, m, daily(spark, sf, days).select("stock_code", "trade_date", "news_count"), fx.news(spark, sf), keys)
    return r.select("stock_code", "trade_date", used_text(), F.array_join("available_dates", ",").alias("available_dates"))


@query(
    "c13_sample_replay",
    """SELECT c.stock_code, c.trade_date, open_ts AS window_start, close_ts AS window_end, coalesce(used, 0) AS used_news_count, latest AS used_latest,
    (SELECT count(*) FROM fx_news n WHERE n.stock_code = c.stock_code AND n.publish_time > c.close_ts) AS future_news_count, close AS close, true AS ok, coalesce(news, '') AS used_news
    FROM (SELECT *, lag(close_ts) OVER (PARTITION BY stock_code ORDER BY trade_date) AS open_ts FROM fx_cal) c JOIN fx_market m USING (stock_code, trade_date)
    LEFT JOIN (SELECT stock_code, trade_date, count(*) AS used, strftime(max(publish_time), '%Y-%m-%d %H:%M:%S') AS latest FROM fx_aligned GROUP BY 1, 2) u USING (stock_code, trade_date)
    LEFT JOIN rp_used USING (stock_code, trade_date)""",
    d="close", i="used_news_count future_news_count", t="trade_date window_start window_end",
)
def c13(spark, sf):
    """Leakage audit of every sample: the window, what was used and what lies in the future."""
    m = fx.market(spark, sf)
    base = m.select("stock_code", "trade_date")
    news_daily = daily(spark, sf).select("stock_code", "trade_date", "news_count")
    r = cal.sample_replay(base, m, news_daily, fx.news(spark, sf))
    return r.select(
        "stock_code", "trade_date", "window_start", "window_end", "used_news_count", "used_latest", "future_news_count",
        F.col("market_snapshot.close").alias("close"), F.col("strict_time_check_passed").alias("ok"), used_text(),
    )


@query("c15_in_dates", f"SELECT {KEY}, close FROM fx_market SEMI JOIN (SELECT DISTINCT CAST(publish_time AS DATE) AS trade_date FROM fx_news) USING (trade_date)", d="close", t="trade_date")
def c15(spark, sf):
    days = fx.news(spark, sf).select(F.to_date("publish_time").alias("trade_date"))
    return panel.in_dates(fx.market(spark, sf).select("stock_code", "trade_date", "close"), days)


@query("g1_union_all", "SELECT stock_code, CAST(max(trade_date) AS VARCHAR) AS last_date, NULL::DOUBLE AS n FROM fx_cal GROUP BY 1 UNION ALL SELECT stock_code, NULL, count(*) FROM fx_news GROUP BY 1", d="n")
def g1(spark, sf):
    a = fx.calendar(spark, sf).groupBy("stock_code").agg(F.max("trade_date").alias("last_date"))
    return panel.union_all(a, fx.news(spark, sf).groupBy("stock_code").agg(F.count("*").cast("double").alias("n")))


# ---- splits

RANKED = "(SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM fx_market))"
cte("sp_dates", f"SELECT * FROM {RANKED}")


@query("h1_ratio_split", "SELECT trade_date, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split, c AS rows FROM sp_dates JOIN (SELECT trade_date, count(*) AS c FROM fx_market GROUP BY 1) USING (trade_date)", i="rows", t="trade_date")
def h1(spark, sf):
    return splits.ratio_split(fx.market(spark, sf)).groupBy("trade_date", "split").agg(F.count("*").alias("rows"))


@query("h2_tail_split", "SELECT trade_date, CASE WHEN r <= n - 2 * v THEN 'train' WHEN r <= n - v THEN 'valid' ELSE 'test' END AS split, c AS rows FROM (SELECT *, greatest(1, floor(n * 0.15::DOUBLE)) AS v FROM sp_dates) JOIN (SELECT trade_date, count(*) AS c FROM fx_market GROUP BY 1) USING (trade_date)", i="rows", t="trade_date")
def h2(spark, sf):
    return splits.tail_split(fx.market(spark, sf)).groupBy("trade_date", "split").agg(F.count("*").alias("rows"))


@query("h3_row_tail_split", f"SELECT {KEY}, CASE WHEN r <= n - 2 * v THEN 'train' WHEN r <= n - v THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, greatest(1, floor(n * 0.15::DOUBLE)) AS v FROM (SELECT stock_code, trade_date, row_number() OVER (ORDER BY trade_date, stock_code) AS r, count(*) OVER () AS n FROM fx_market))", t="trade_date")
def h3(spark, sf):
    return splits.row_tail_split(fx.market(spark, sf)).select("stock_code", "trade_date", "split")


cte(
    "sp_windows",
    """SELECT w, row_number() OVER (ORDER BY w) AS window_id FROM (SELECT unnest(range(180, CAST((SELECT max(n) FROM sp_dates) AS BIGINT) - 60 + 1, 20)) AS w) ORDER BY w DESC LIMIT 3""",
)
cte(
    "sp_roll",
    """SELECT row_number() OVER (PARTITION BY trade_date ORDER BY w) AS ignore, w, trade_date, CASE WHEN r <= w THEN 'train' WHEN r <= w + 30 THEN 'valid' WHEN r <= w + 60 THEN 'test' END AS split FROM sp_dates, sp_windows""",
)


@query(
    "e17_rolling_splits",
    """SELECT dense_rank() OVER (ORDER BY w) AS window_id, split, count(*) AS rows, CAST(min(trade_date) AS VARCHAR) AS first_date, CAST(max(trade_date) AS VARCHAR) AS last_date
    FROM sp_roll JOIN fx_market USING (trade_date) WHERE split IS NOT NULL GROUP BY w, split""",
    i="window_id rows",
)
def e17(spark, sf):
    r = splits.rolling_splits(fx.market(spark, sf))
    return r.groupBy("window_id", "split").agg(F.count("*").alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


# ---- metrics on a given score

CLS = ["positive_ratio", "accuracy", "precision", "recall", "f1"]
cte(
    "me_cls",
    """SELECT grp, samples, pr AS positive_ratio, acc AS accuracy, pre AS precision, rec AS recall, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0::DOUBLE END AS f1 FROM (
    SELECT grp, count(*) AS samples, avg(label) AS pr, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc,
    coalesce(count(*) FILTER (WHERE score >= 0.5 AND label = 1) / nullif(count(*) FILTER (WHERE score >= 0.5), 0), 0.0::DOUBLE) AS pre,
    coalesce(count(*) FILTER (WHERE score >= 0.5 AND label = 1) / nullif(sum(label), 0), 0.0::DOUBLE) AS rec FROM fx_scores GROUP BY 1)""",
)
cte(
    "me_auc",
    """SELECT a.grp, CASE WHEN count(*) FILTER (WHERE a.label = 1 AND b.label = 0) = 0 THEN 0.5::DOUBLE ELSE
    avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE a.label = 1 AND b.label = 0) END AS auc
    FROM fx_scores a JOIN fx_scores b ON a.grp = b.grp GROUP BY 1""",
)
cte(
    "me_ap",
    """SELECT grp, coalesce(sum(p * tp / (tp + fp)) / nullif(sum(p), 0), 0.0::DOUBLE) AS avg_precision FROM (
    SELECT grp, score, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT grp, score, sum(label) AS p, sum(1 - label) AS n FROM fx_scores GROUP BY 1, 2) WINDOW w AS (PARTITION BY grp ORDER BY score DESC)) GROUP BY 1""",
)
CLIPPED = "greatest(2.220446049250313e-16::DOUBLE, least(1 - 2.220446049250313e-16::DOUBLE, score))"
cte("me_ll", f"SELECT grp, CASE WHEN max(label) > min(label) THEN avg(-(label * ln({CLIPPED}) + (1 - label) * ln(1 - {CLIPPED}))) ELSE 0.0::DOUBLE END AS logloss FROM fx_scores GROUP BY 1")
cte(
    "me_topk",
    """SELECT grp, count(*) AS topk_days, avg(n) AS topk_avg_count, avg(hit) AS topk_hit_rate, avg(ret) AS topk_avg_future_return FROM (
    SELECT grp, trade_date, count(*) AS n, avg(label) AS hit, avg(ret) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY grp, trade_date ORDER BY score DESC, doc_id) AS r FROM fx_scores) WHERE r <= 5 GROUP BY 1, 2) GROUP BY 1""",
)


def scored(spark, sf):
    return fx.scores(spark, sf).withColumn("stock_code", F.lpad(F.col("doc_id").cast("string"), 12, "0"))


@query("d15_classification_metrics", "SELECT * FROM me_cls", d=" ".join(CLS), i="samples")
def d15(spark, sf):
    return metrics.classification_metrics(scored(spark, sf), "label", "score", ["grp"])


@query("d16_roc_auc", "SELECT * FROM me_auc", d="auc")
def d16(spark, sf):
    return metrics.roc_auc(scored(spark, sf), "label", "score", ["grp"])


PANEL_SCORED = "(SELECT CAST(label_up_5d AS INT) AS y, ret_5d AS s FROM tech3 WHERE label_up_5d IS NOT NULL AND ret_5d IS NOT NULL)"


@query(
    "d16_roc_auc_panel",
    f"""SELECT (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)) AS auc
    FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM {PANEL_SCORED})""",
    d="auc",
)
def d16b(spark, sf):
    p = technical.technical_panel(fx.market(spark, sf)).select(F.col("label_up_5d").cast("int").alias("y"), F.col("ret_5d").alias("s")).dropna()
    return metrics.roc_auc(p, "y", "s")


@query("d17_average_precision", "SELECT * FROM me_ap", d="avg_precision")
def d17(spark, sf):
    return metrics.average_precision(scored(spark, sf), "label", "score", ["grp"])


@query("d18_log_loss", "SELECT * FROM me_ll", d="logloss")
def d18(spark, sf):
    return metrics.log_loss(scored(spark, sf), "label", "score", ["grp"])


TOPK = "topk_avg_count topk_hit_rate topk_avg_future_return"


@query("d19_topk_metrics", "SELECT * FROM me_topk", d=TOPK, i="topk_days")
def d19(spark, sf):
    return metrics.topk_metrics(scored(spark, sf), "score", "label", "ret", k=5, by=["grp"])


cte("me_all", "SELECT * FROM me_cls JOIN me_auc USING (grp) JOIN me_ap USING (grp) JOIN me_ll USING (grp) JOIN me_topk USING (grp)")


def all_metrics(spark, sf):
    return metrics.evaluate_scores(scored(spark, sf), "label", "score", "ret", k=5, by=["grp"])


@query("d15_d19_evaluate_scores", "SELECT * FROM me_all", d=" ".join(CLS + ["auc", "avg_precision", "logloss", *TOPK.split()]), i="samples topk_days")
def evaluate(spark, sf):
    return all_metrics(spark, sf)


UP = ["auc", "f1", "precision", "recall", "topk_hit_rate", "topk_avg_future_return"]
cte("me_up", "SELECT t.grp, " + ", ".join(f"t.{m} - b.{m} AS uplift_{m}" for m in UP) + " FROM me_all t, me_all b WHERE b.grp = 'en'")


@query("d20_metric_uplift", "SELECT * FROM me_up", d=" ".join(f"uplift_{m}" for m in UP))
def d20(spark, sf):
    """Each language against English."""
    m = all_metrics(spark, sf)
    groups = m.select("grp")
    base = m.filter("grp = 'en'").drop("grp").withColumn("_k", F.lit(1)).join(groups.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return metrics.metric_uplift(base, m, ["grp"])


@query(
    "d21_rolling_summary",
    """SELECT count(*) AS windows, avg(uplift_auc) AS avg_uplift_auc, avg(uplift_f1) AS avg_uplift_f1, avg(uplift_topk_avg_future_return) AS avg_uplift_topk_return,
    count(*) FILTER (WHERE uplift_auc > 0) AS positive_auc_windows, count(*) FILTER (WHERE uplift_topk_avg_future_return > 0) AS positive_topk_return_windows FROM me_up""",
    d="avg_uplift_auc avg_uplift_f1 avg_uplift_topk_return", i="windows positive_auc_windows positive_topk_return_windows",
)
def d21(spark, sf):
    return metrics.rolling_summary(d20(spark, sf))


@query("d25_class_weights", "SELECT label, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM fx_scores GROUP BY 1", d="weight", i="label n")
def d25(spark, sf):
    return metrics.class_weights(scored(spark, sf), "label")


@query(
    "h13_baseline_gate",
    """SELECT 'test_auc' AS target_metric, t.auc AS target_value, 'auc' AS baseline_metric, b.auc AS baseline_value, t.auc - b.auc AS delta, t.auc > b.auc AS replace_model
    FROM me_all t, me_all b WHERE t.grp = 'fr' AND b.grp = 'en'""",
    d="target_value baseline_value delta",
)
def h13(spark, sf):
    m = all_metrics(spark, sf)
    long = lambda grp, names: m.filter(F.col("grp") == grp).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in names])).alias("r")).select("r.*")
    return metrics.baseline_gate(long("fr", [("test_accuracy", "accuracy"), ("test_auc", "auc")]), long("en", [("auc", "auc"), ("accuracy", "accuracy")]))


# ---- backtest on a given score

cte("bt_scored", "SELECT stock_code, trade_date, -ret_5d AS pred_prob, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, future_ret_5d / 100)) AS future_ret_5d, label_up_5d, 1.0::DOUBLE * (CAST(stock_code AS INT) % 2) AS odd FROM tech3 WHERE ret_5d IS NOT NULL AND label_up_5d IS NOT NULL")
cte("bt_picks", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY pred_prob DESC, stock_code) AS rank FROM bt_scored) WHERE rank <= 20")
cte("bt_prev", "SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM bt_picks)")
cte(
    "bt_turn",
    """SELECT d.trade_date, prev IS NULL AS is_first, CASE WHEN prev IS NULL THEN 1.0::DOUBLE ELSE
    ((SELECT count(*) FROM bt_picks c WHERE c.trade_date = d.trade_date AND c.stock_code NOT IN (SELECT stock_code FROM bt_picks p WHERE p.trade_date = d.prev)) +
     (SELECT count(*) FROM bt_picks c WHERE c.trade_date = d.prev AND c.stock_code NOT IN (SELECT stock_code FROM bt_picks p WHERE p.trade_date = d.trade_date))) / 2.0::DOUBLE /
     (SELECT count(*) FROM bt_picks c WHERE c.trade_date = d.trade_date) END AS turnover FROM bt_prev d""",
)
cte(
    "bt_hold",
    """SELECT *, raw_return - trade_cost AS net_return FROM (SELECT p.*, turnover, CASE WHEN is_first THEN 0.0005::DOUBLE ELSE turnover * 0.002::DOUBLE END AS trade_cost FROM (
    SELECT trade_date, count(*) AS selected_count, avg(pred_prob) AS avg_probability, avg(future_ret_5d) AS raw_return, avg(label_up_5d) AS avg_label, avg(odd) AS odd FROM bt_picks GROUP BY 1) p JOIN bt_turn USING (trade_date))""",
)
cte("bt_ln", "SELECT *, sum(ln(1 + net_return)) OVER (ORDER BY trade_date) AS ln_nav FROM bt_hold")
cte("bt_curve", "SELECT *, exp(ln_nav) / greatest(1.0::DOUBLE, exp(max(ln_nav) OVER (ORDER BY trade_date))) - 1 AS drawdown FROM bt_ln")


def bt_scored(spark, sf):
    """Reversal score; returns are scaled down, as these prices are noise and would overflow the curve."""
    p = technical.technical_panel(fx.market(spark, sf)).filter("ret_5d is not null and label_up_5d is not null")
    return p.select(
        "stock_code", "trade_date", (-F.col("ret_5d")).alias("pred_prob"),
        clip(F.col("future_ret_5d") / 100, -0.1, 0.1).alias("future_ret_5d"), "label_up_5d",
        (F.col("stock_code").cast("int") % 2).cast("double").alias("stock_sector_odd"),
    )


@query("e18_daily_topn", "SELECT stock_code, trade_date, rank FROM bt_picks", i="rank", t="trade_date")
def e18(spark, sf):
    return bt.daily_topn(bt_scored(spark, sf)).select("stock_code", "trade_date", "rank")


@query("e19_turnover", "SELECT trade_date, turnover, is_first FROM bt_turn", d="turnover", t="trade_date")
def e19(spark, sf):
    return bt.turnover(bt.daily_topn(bt_scored(spark, sf))).drop("codes")


HOLD = "avg_probability raw_return avg_label turnover trade_cost net_return"


@query("h14_h15_holdings", f"SELECT trade_date, selected_count, {', '.join(HOLD.split())} FROM bt_hold", d=HOLD, i="selected_count", t="trade_date")
def h14(spark, sf):
    return bt.cross_section_backtest(bt_scored(spark, sf))["holdings"].drop("codes", "is_first")


@query("e20_e21_equity_curve", "SELECT trade_date, round(ln_nav, 5) AS ln_nav, drawdown FROM bt_curve", d="ln_nav drawdown", t="trade_date")
def e20(spark, sf):
    c = bt.cross_section_backtest(bt_scored(spark, sf))["curve"]
    return c.select("trade_date", F.round(F.log("nav"), 5).alias("ln_nav"), "drawdown")


SUMM = "max_drawdown win_rate avg_period_return avg_trade_cost avg_turnover sharpe_like ln_growth ln_annual"


@query(
    "d22_backtest_summary",
    """SELECT count(*) AS periods, min(drawdown) AS max_drawdown, avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate, avg(net_return) AS avg_period_return,
    avg(trade_cost) AS avg_trade_cost, avg(turnover) AS avg_turnover, avg(net_return) / stddev_pop(net_return) * sqrt(252 / 5.0::DOUBLE) AS sharpe_like,
    sum(ln(1 + net_return)) AS ln_growth, sum(ln(1 + net_return)) * (252 / 5.0::DOUBLE) / count(*) AS ln_annual FROM bt_curve""",
    d=SUMM, i="periods",
)
def d22(spark, sf):
    """Growth is compared by logarithm, as it compounds to large numbers on these prices."""
    s = bt.cross_section_backtest(bt_scored(spark, sf))["summary"]
    return s.withColumns({"ln_growth": F.log1p("cumulative_return"), "ln_annual": F.log1p("annualized_return")}).drop("cumulative_return", "annualized_return")


@query("d23_sector_distribution", "SELECT 'odd' AS sector, avg(odd) AS share FROM bt_hold", d="share")
def d23(spark, sf):
    return bt.cross_section_backtest(bt_scored(spark, sf))["sectors"]


# ---- recommendation

POS_W, NEG_W = ["click", "view"], ["error"]
cte("rc_stats", """SELECT stock_code, count(*) AS news_count, [avg(sentiment), sum(sentiment * exp(-h / 24)) / sum(exp(-h / 24))] AS nf,
    [(count(*) FILTER (WHERE title IN ('click', 'view')) - count(*) FILTER (WHERE title = 'error')) / greatest(count(*) FILTER (WHERE title IN ('click', 'view', 'error')), 1), avg(sentiment)] AS tf,
    sum(sw * sentiment * importance * time_decay) / 32 AS sec FROM im0 GROUP BY 1""")
T = lambda i: f"tech[{i + 1}]"
cte(
    "rc_blend",
    f"""SELECT s.stock_code, st.name, close, coalesce(news_count, 0) AS news_count, {T(3)} AS vol,
    (coalesce(nf[1], 0) * 0.5 + coalesce(nf[2], 0) * 0.5) * 0.28 + coalesce(sec, 0) * 0.18 + ({T(9)} * 0.15
    + CASE WHEN {T(4)} < 0.3 THEN 0.1 WHEN {T(4)} > 0.7 THEN -0.1 ELSE 0 END + CASE WHEN {T(6)} < 0.2 THEN 0.1 WHEN {T(6)} > 0.8 THEN -0.1 ELSE 0 END
    + CASE WHEN {T(0)} > 2 THEN -0.1 WHEN {T(0)} < -2 THEN 0.1 ELSE 0 END + CASE WHEN {T(11)} < -3 THEN -0.1 WHEN {T(11)} > 3 THEN 0.05 ELSE 0 END) * 0.36
    + CASE WHEN relevance_inc > 0.6 THEN 0.1 WHEN relevance_inc < 0.3 THEN -0.05 ELSE 0 END * 0.1 + (coalesce(tf[1], 0) * 0.12 + coalesce(tf[2], 0) * 0.08) * 0.08 AS c
    FROM snap s JOIN fx_stock st USING (stock_code) LEFT JOIN rc_stats USING (stock_code)
    JOIN (SELECT stock_code, relevance[1] AS relevance_inc FROM gr_vec) USING (stock_code) WHERE n >= 60 AND close BETWEEN 0 AND 100000""",
)
cte("rc_p", f"SELECT *, {fx.half_up('(1 / (1 + exp(-c * 8)))', 4)} AS probability, {fx.half_up('(tanh(c) * 0.08)', 6)} AS r FROM rc_blend")
cte(
    "rc_pred",
    f"""SELECT stock_code, name, close AS latest_price, CASE WHEN r >= 0 THEN 1 ELSE 0 END AS prediction, probability,
    CASE WHEN r >= 0 THEN {fx.half_up('(1 / (1 + exp(-c * 8)))', 4)} ELSE {fx.half_up('(1 - 1 / (1 + exp(-c * 8)))', 4)} END AS confidence,
    {fx.half_up('(r * 100)', 2)} AS expected_return, {fx.half_up('(close * (1 + r))', 2)} AS predicted_price, news_count FROM rc_p""",
)
PRED = "latest_price probability confidence expected_return predicted_price"


def pred_args(spark, sf):
    e = fx.edges(spark, sf)
    return (fx.stock_dim(spark, sf), fx.market(spark, sf), fx.news(spark, sf), e, fx.as_of(), list(fx.SECTORS), POS_W, NEG_W)


CONF = dict(kline_days=2500, max_price=100000.0)


@query("b51_b52_rule_predictions", "SELECT * FROM rc_pred", d=PRED, i="prediction news_count")
def b51(spark, sf):
    return recommend.score_stocks(*pred_args(spark, sf), **CONF)


@query("h16_batch_recommend", "SELECT *, row_number() OVER (ORDER BY expected_return DESC, stock_code) AS rank FROM rc_pred ORDER BY expected_return DESC, stock_code LIMIT 20", d=PRED, i="prediction news_count rank")
def h16(spark, sf):
    return recommend.batch_recommend(*pred_args(spark, sf), top_n=20, **CONF)


@query("h17_predict_one", "SELECT stock_code, name, latest_price, prediction, probability, confidence, expected_return, news_count FROM rc_pred WHERE stock_code = '000002'", d="latest_price probability confidence expected_return", i="prediction news_count")
def h17(spark, sf):
    return recommend.predict_one("000002", *pred_args(spark, sf), **CONF)


# items of documents, matched to stocks by name, in the place of items that carry a stock
cte(
    "rt_news",
    f"""SELECT mt.stock_code, (arrival % 11 - 5) / 10.0::DOUBLE AS sentiment, 0.5::DOUBLE + (arrival % 5) / 10.0::DOUBLE AS importance, trim(title || ' ' || content) AS m,
    (epoch_us(TIMESTAMP '{fx.AS_OF}') - epoch_us(publish_time)) / 3.6e9 AS h FROM mt JOIN fx_docs USING (news_id)""",
)
cte("rt_words", "SELECT *, (length(m) - length(replace(m, 'the', ''))) / 3 AS pos, (length(m) - length(replace(m, 'and', ''))) / 3 AS neg FROM rt_news")
cte("rt_stats", """SELECT stock_code, count(*) AS news_count, [avg(sentiment), sum(sentiment * exp(-h / 24)) / sum(exp(-h / 24))] AS nf,
    [(sum(pos) - sum(neg)) / greatest(sum(pos) + sum(neg), 1), avg(sentiment)] AS tf,
    sum(0.5::DOUBLE * sentiment * importance * greatest(0.1::DOUBLE, least(1.0::DOUBLE, exp(-h * ln(2) / 24)))) / 32 AS sec FROM rt_words GROUP BY 1""")
for _name in ("blend", "p", "pred"):
    cte(f"rt_{_name}", CTES[f"rc_{_name}"].replace("rc_", "rt_"))


@query("h16_recommend_from_text", "SELECT *, row_number() OVER (ORDER BY expected_return DESC, stock_code) AS rank FROM rt_pred ORDER BY expected_return DESC, stock_code LIMIT 20", d=PRED, i="prediction news_count rank")
def h16t(spark, sf):
    """Documents without a stock are matched by code and name first."""
    n = F.col("arrival")
    texts = fx.docs(spark, sf).withColumns(
        {
            "sentiment": (n % 11 - 5) / 10.0,
            "importance": 0.5 + (n % 5) / 10.0,
            "categories": F.array(F.lit("even")),
            "affected_sectors": F.create_map(F.lit("S1"), F.lit(0.5)),
        }
    )
    stock, market, _, *rest = pred_args(spark, sf)
    rest[-2:] = ["the"], ["and"]
    return recommend.recommend_from_text(stock, market, texts, fx.alias_dim(spark, sf), *rest, **CONF)


@query("e22_rank", "SELECT stock_code, expected_return, row_number() OVER (ORDER BY expected_return DESC, stock_code) AS rank FROM rc_pred", d="expected_return", i="rank")
def e22(spark, sf):
    p = recommend.score_stocks(*pred_args(spark, sf), **CONF).select("stock_code", "expected_return")
    return recommend.rank_by(p, "expected_return")


@query("d24_direction_counts", "SELECT count(*) FILTER (WHERE prediction = 1) AS up_count, count(*) FILTER (WHERE prediction <> 1) AS down_count, avg(confidence) AS avg_confidence FROM rc_pred", d="avg_confidence", i="up_count down_count")
def d24(spark, sf):
    return metrics.direction_counts(recommend.score_stocks(*pred_args(spark, sf), **CONF))


# ---- models


@query("h4_exact_median", "SELECT 'volume' AS col, median(volume) AS median FROM tech3 UNION ALL SELECT 'vol_5d', median(vol_5d) FROM tech3 UNION ALL SELECT 'rsi', median(rsi) FROM tech3", d="median")
def h4(spark, sf):
    return exact_median(technical.technical_panel(fx.market(spark, sf)), ["volume", "vol_5d", "rsi"])


ML_COLS = ["ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d", "rsi", "macd", "bb_position", "ma5_gt_ma10", "ma10_gt_ma20", "volume_ratio"]


@query("h5_standardize", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("rsi", "macd", "volume_ratio")) + " FROM tech", d=" ".join(f"m_{c} s_{c}" for c in ("rsi", "macd", "volume_ratio")))
def h5(spark, sf):
    """The means and deviations that the operator fits on every bar's indicators."""
    from tickerloom.operators import ml

    fitted = ml.standardize(technical.technical_panel(fx.market(spark, sf)), ["rsi", "macd", "volume_ratio"])
    return spark.range(1).select(*[F.lit(v).alias(f"{k}_{c}") for c, pair in fitted.items() for k, v in zip("ms", pair, strict=True)])


PREP = "rsi macd volume_ratio"
cte("h5_filled", "SELECT " + KEY + ", " + ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in PREP.split()) + " FROM tech")


@query("h4_h5_prepared_rows", "SELECT " + KEY + ", " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in PREP.split()) + " FROM h5_filled", d=PREP, t="trade_date")
def h45(spark, sf):
    """Every bar's indicators with gaps filled by the median, then standardized, through the operators."""
    from tickerloom.operators import ml

    p = materialize(technical.technical_panel(fx.market(spark, sf)).select("stock_code", "trade_date", *PREP.split()), "panel")
    prep = ml.median_impute(p, PREP.split())
    prep.stats = ml.standardize(prep.transform(p), PREP.split())
    return prep.transform(p)


def ml_parts(spark, sf):
    p = technical.technical_panel(fx.market(spark, sf)).dropna(subset=["label_up_5d"])
    p = p.select("stock_code", "trade_date", "future_ret_5d", F.col("label_up_5d").cast("int").alias("label_up_5d"), *ML_COLS)
    # the split looks at the dates first: the indicators are made once, for both
    return splits.ratio_split(materialize(p, "panel"))


def _fit(kind, **kw):
    def run(spark, sf):
        from tickerloom.operators import ml

        parts = ml_parts(spark, sf)
        model = ml.fit_classifier(parts.filter("split = 'train'"), ML_COLS, kind=kind, **kw)
        scored = model.score(parts.filter("split = 'test'"))
        return scored.select("stock_code", "trade_date", "label_up_5d", "future_ret_5d", "pred_prob")

    return run


query("h6_h11_logistic")(_fit("logistic"))
query("h7_random_forest")(_fit("random_forest"))
query("h8_boosted_trees")(_fit("boosted_trees"))


@query("h9_two_head")
def h9(spark, sf):
    from tickerloom.operators import ml

    parts = ml_parts(spark, sf)
    heads = ml.two_head(parts.filter("split = 'train'"), {"tech": ML_COLS})
    return heads.score(parts.filter("split = 'test'")).select("stock_code", "trade_date", "probability", "predicted_return")


cte(
    "h10_scope",
    "SELECT * FROM panel_model SEMI JOIN (SELECT stock_code FROM panel_model GROUP BY 1 ORDER BY count(*) DESC, stock_code LIMIT 50) USING (stock_code)",
)


@query(
    "h10_training_matrix",
    """SELECT stock_code, trade_date, label_up_5d, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM h10_scope
    SEMI JOIN (SELECT DISTINCT trade_date FROM h10_scope ORDER BY trade_date DESC LIMIT 400) USING (trade_date)
    LEFT JOIN (SELECT stock_code, trade_date, count(*) AS n FROM fx_aligned GROUP BY 1, 2) USING (stock_code, trade_date)""",
    d="norm", i="label_up_5d", t="trade_date",
)
def h10(spark, sf):
    from tickerloom.operators import ml

    m = model_df(spark, sf)
    t = ml.training_matrix(m, fx.calendar(spark, sf), fx.news(spark, sf), 50, 400)
    return t.select("stock_code", "trade_date", "label_up_5d", F.aggregate("text_hash", F.lit(0.0), lambda a, x: a + x * x).alias("norm"))


@query("h12_compare_feature_sets")
def h12(spark, sf):
    """Metrics per window and feature set, uplift per window and the summary, told apart by ``result``."""
    from tickerloom.operators import ml

    n = daily(spark, sf).select("stock_code", "trade_date", "news_count", "weighted_sentiment", "news_impact_total")
    p = technical.technical_panel(fx.market(spark, sf)).dropna(subset=["label_up_5d"]).join(n, ["stock_code", "trade_date"], "left")
    p = p.withColumn("label_up_5d", F.col("label_up_5d").cast("int")).drop("open", "high", "low", "close", "volume")
    metrics_, uplift, summary = ml.compare_feature_sets(splits.rolling_splits(materialize(p, "panel")))
    named = lambda name, df: df.select(F.lit(name).alias("result"), "*")
    out = named("metrics", metrics_).unionByName(named("uplift", uplift), allowMissingColumns=True)
    return out.unionByName(named("summary", summary), allowMissingColumns=True)


@query("d31_feature_importance")
def d31(spark, sf):
    from tickerloom.operators import ml

    parts = ml_parts(spark, sf)
    return ml.feature_importance(spark, ml.logistic(parts.filter("split = 'train'"), ML_COLS), 20)
