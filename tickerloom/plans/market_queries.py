"""Queries on daily bars: indicators, labels, snapshots, coverage."""

from pyspark.sql import functions as F

from tickerloom.functions import technical as t
from tickerloom.functions.maths import zero_to_null
from tickerloom.operators import panel, technical
from tickerloom.operators.dedupe import dedupe_by_date
from tickerloom.operators.ewm import ewm, macd
from tickerloom.operators.metrics import topk_metrics
from tickerloom.plans import fixtures as fx
from tickerloom.plans.registry import cte, query
from tickerloom.operators.ordered import scratch_path
from tickerloom.sources import datasets, market as src

W = "PARTITION BY stock_code ORDER BY trade_date"
cte(
    "tech0",
    f"""SELECT *, lag(close, 1) OVER w AS c1, lag(close, 5) OVER w AS c5, lag(close, 20) OVER w AS c20, lead(close, 5) OVER w AS f5,
    row_number() OVER w AS rn FROM fx_market WINDOW w AS ({W})""",
)
cte(
    "tech1",
    """SELECT *, close / c1 - 1 AS ret_1d, close / c5 - 1 AS ret_5d, close / c20 - 1 AS ret_20d,
    greatest(coalesce(close - c1, 0), 0) AS gain, greatest(coalesce(c1 - close, 0), 0) AS loss, f5 / close - 1 AS future_ret_5d FROM tech0""",
)
cte(
    "tech2",
    f"""SELECT *, CASE WHEN count(ret_1d) OVER w5 = 5 THEN stddev_samp(ret_1d) OVER w5 END AS vol_5d,
    CASE WHEN count(ret_1d) OVER w20 = 20 THEN stddev_samp(ret_1d) OVER w20 END AS vol_20d,
    CASE WHEN rn >= 14 THEN (100 - 100 / (1 + (avg(gain) OVER w14) / ((avg(loss) OVER w14) + 1e-10))) / 100 END AS rsi,
    CASE WHEN rn >= 5 THEN avg(close) OVER w5 END AS ma5, CASE WHEN rn >= 10 THEN avg(close) OVER w10 END AS ma10,
    CASE WHEN rn >= 20 THEN avg(close) OVER w20 END AS ma20, CASE WHEN rn >= 20 THEN stddev_samp(close) OVER w20 END AS sd20,
    CASE WHEN rn >= 20 THEN volume / (avg(volume) OVER w20) END AS volume_ratio
    FROM tech1 WINDOW w5 AS ({W} ROWS 4 PRECEDING), w10 AS ({W} ROWS 9 PRECEDING), w14 AS ({W} ROWS 13 PRECEDING), w20 AS ({W} ROWS 19 PRECEDING)""",
)
cte(
    "tech3",
    """SELECT *, (close - (ma20 - 2 * sd20)) / (4 * sd20 + 1e-10) AS bb_position,
    CASE WHEN ma5 > ma10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ma5_gt_ma10, CASE WHEN ma10 > ma20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ma10_gt_ma20,
    CASE WHEN future_ret_5d > 0.01 THEN 1.0::DOUBLE WHEN future_ret_5d IS NOT NULL THEN 0.0::DOUBLE END AS label_up_5d FROM tech2""",
)


def fold(col: str, span: int, order: str = W) -> str:
    """SQL of an exponential mean: a left fold over the rows so far."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"list_reduce(list({col}) OVER ({order} ROWS UNBOUNDED PRECEDING), lambda y, x: (1 - {a}) * y + {a} * x)"


cte("tech_ema", f"SELECT stock_code, trade_date, close, {fold('close', 12)} AS ema12, {fold('close', 26)} AS ema26 FROM fx_market")
cte(
    "tech",
    "SELECT tech3.*, (ema12 - ema26) / tech3.close AS macd FROM tech3 JOIN tech_ema USING (stock_code, trade_date)",
)
KEY = "stock_code, trade_date"


@query(
    "entry_momentum_topk",
    """SELECT trade_date, count(*) AS picked, avg(label_up_5d) AS hit_rate, avg(future_ret_5d) AS avg_return FROM (
    SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ret_5d DESC, stock_code) AS r FROM tech3
    WHERE ret_5d IS NOT NULL AND label_up_5d IS NOT NULL) WHERE r <= 5 GROUP BY trade_date""",
    d="hit_rate avg_return", i="picked", t="trade_date",
)
def momentum_topk(spark, sf):
    """Each day, the five stocks of strongest five-bar momentum: hit rate and mean return ahead."""
    p = technical.technical_panel(fx.market(spark, sf)).select("stock_code", "trade_date", "ret_5d", "future_ret_5d", "label_up_5d")
    p = p.filter("ret_5d is not null and label_up_5d is not null")
    return (
        panel.top_k_per(p, "trade_date", "ret_5d", 5)
        .groupBy("trade_date")
        .agg(F.count("*").alias("picked"), F.avg("label_up_5d").alias("hit_rate"), F.avg("future_ret_5d").alias("avg_return"))
    )


def _technical(name, *cols, source="tech3"):
    @query(name, f"SELECT {KEY}, {', '.join(cols)} FROM {source}", d=" ".join(cols), t="trade_date")
    def run(spark, sf):
        return technical.technical_panel(fx.market(spark, sf)).select("stock_code", "trade_date", *cols)


_technical("e1_pct_change", "ret_1d", "ret_5d", "ret_20d")
_technical("e2_rolling_volatility", "vol_5d", "vol_20d")
_technical("e3_rsi_14", "rsi")
_technical("e6_bollinger_position", "bb_position")
_technical("e7_ma_cross", "ma5_gt_ma10", "ma10_gt_ma20")
_technical("e8_volume_ratio", "volume_ratio")
_technical("e9_future_return_label", "future_ret_5d", "label_up_5d")
_technical(
    "e_technical_panel", "ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d", "rsi", "macd", "bb_position",
    "ma5_gt_ma10", "ma10_gt_ma20", "volume_ratio", "future_ret_5d", "label_up_5d", source="tech",
)


@query("e4_ewm", f"SELECT {KEY}, round(ema12 + 1e-9, 4) AS ema12, round(ema26 + 1e-9, 4) AS ema26 FROM tech_ema", d="ema12 ema26", t="trade_date")
def e4(spark, sf):
    """Prices run into the thousands, so the means are compared to four places."""
    e = ewm(fx.market(spark, sf).select("stock_code", "trade_date", "close"), {"close": [("ema12", 12), ("ema26", 26)]})
    return e.select("stock_code", "trade_date", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("ema12", "ema26")])


@query("e5_macd", f"SELECT {KEY}, (ema12 - ema26) / close AS macd FROM tech_ema", d="macd", t="trade_date")
def e5(spark, sf):
    return macd(fx.market(spark, sf).select("stock_code", "trade_date", "close")).drop("close")


@query("e10_change_pct", f"SELECT {KEY}, 100 * ret_1d AS change_pct FROM tech1", d="change_pct", t="trade_date")
def e10(spark, sf):
    return fx.market(spark, sf).select("stock_code", "trade_date", t.change_pct(F.col("close"), t.by_stock()).alias("change_pct"))


@query("e12_min_history", f"SELECT {KEY}, close FROM fx_market SEMI JOIN (SELECT stock_code FROM fx_market GROUP BY 1 HAVING count(*) >= 530) USING (stock_code)", d="close", t="trade_date")
def e12(spark, sf):
    return technical.min_history(fx.market(spark, sf), 530).select("stock_code", "trade_date", "close")


LATEST = "SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS age, count(*) OVER (PARTITION BY stock_code) AS n FROM tech3"
cte("tech_latest", LATEST)


@query("e13_tail_days", f"SELECT {KEY}, close, volume FROM tech_latest WHERE age <= 30", d="close volume", t="trade_date")
def e13(spark, sf):
    return technical.tail_days(fx.market(spark, sf), 30).select("stock_code", "trade_date", "close", "volume")


@query(
    "e15_price_position",
    f"""SELECT {KEY}, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5::DOUBLE END AS price_position FROM (
    SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi FROM fx_market WINDOW w AS ({W} ROWS 59 PRECEDING))""",
    d="price_position", t="trade_date",
)
def e15(spark, sf):
    return fx.market(spark, sf).select("stock_code", "trade_date", t.price_position(F.col("close"), 60, t.by_stock()).alias("price_position"))


@query("e23_latest_and_previous", f"SELECT {KEY}, close, age FROM tech_latest WHERE age <= 2", d="close", i="age", t="trade_date")
def e23(spark, sf):
    return technical.latest_and_previous(fx.market(spark, sf)).select("stock_code", "trade_date", "close", "age")


@query(
    "e25_last_dates",
    "SELECT stock_code, string_agg(CAST(trade_date AS VARCHAR), ',' ORDER BY trade_date) AS dates FROM tech_latest WHERE age <= 60 GROUP BY 1",
)
def e25(spark, sf):
    return technical.last_dates(fx.market(spark, sf), 60).select("stock_code", F.array_join("dates", ",").alias("dates"))


@query(
    "d14_stock_price_stats",
    """SELECT stock_code, max(close) FILTER (WHERE age = 1) AS current,
    (max(close) FILTER (WHERE age = 1) - max(close) FILTER (WHERE age = 2)) * 100 / max(close) FILTER (WHERE age = 2) AS change,
    max(high) AS high, min(low) AS low, sum(volume) AS volume, avg(volume) AS avg_volume, count(*) AS days
    FROM tech_latest WHERE age <= 120 GROUP BY 1""",
    d="current change high low volume avg_volume", i="days",
)
def d14(spark, sf):
    return technical.stock_price_stats(fx.market(spark, sf), 120)


SNAP = [
    "(close / c4 - 1) * 100", "(close / c19 - 1) * 100", "s5 * 100", "s20 * 100", "rsi", "(ema12 - ema26) / close * 100",
    "bb_position", "least(volume / vm / 5, 1.0::DOUBLE)", "CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5::DOUBLE END",
    "CASE WHEN ma5 > ma10 AND ma10 > ma20 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END", "(ma5 - ma20) / ma20 * 100", "(close / c10 - 1) * 100",
]
cte(
    "snap0",
    f"""SELECT *, lag(close, 4) OVER w AS c4, lag(close, 19) OVER w AS c19, lag(close, 10) OVER w AS c10,
    stddev_samp(ret_1d) OVER w5 AS s5, stddev_samp(ret_1d) OVER w20 AS s20, avg(volume) OVER w20 AS vm,
    min(close) OVER w60 AS lo, max(close) OVER w60 AS hi,
    row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS age, count(*) OVER (PARTITION BY stock_code) AS n
    FROM tech3 WINDOW w AS ({W}), w5 AS ({W} ROWS 4 PRECEDING), w20 AS ({W} ROWS 19 PRECEDING), w60 AS ({W} ROWS 59 PRECEDING)""",
)
cte(
    "snap",
    f"""SELECT s.stock_code, s.close, s.n, [{', '.join(f'coalesce(({e}), 0.0::DOUBLE)' for e in SNAP).replace('close', 's.close')}] AS tech
    FROM snap0 s JOIN tech_ema e USING (stock_code, trade_date) WHERE age = 1""",
)


@query(
    "e14_tech_snapshot",
    "SELECT stock_code, close AS latest_price, n AS n_rows, generate_subscripts(tech, 1) - 1 AS pos, CASE WHEN n >= 20 THEN unnest(tech) ELSE 0.0::DOUBLE END AS value FROM snap",
    d="latest_price value", i="n_rows pos",
)
def e14(spark, sf):
    s = technical.tech_snapshot(fx.market(spark, sf))
    return s.select("stock_code", "latest_price", "n_rows", F.posexplode("tech").alias("pos", "value"))


@query(
    "a5_coverage_gate",
    f"""SELECT {KEY}, close FROM fx_market SEMI JOIN (SELECT stock_code FROM fx_market GROUP BY 1
    HAVING date_diff('day', max(trade_date), DATE '2001-11-02') <= 7 AND count(*) >= 0.5 * 240) USING (stock_code)""",
    d="close", t="trade_date",
)
def a5(spark, sf):
    return src.coverage_gate(fx.market(spark, sf), F.lit("2001-11-02").cast("date"), 240).select("stock_code", "trade_date", "close")


def bar_folder(spark, sf):
    """The bars as a directory of one folder per stock below the shared folder."""
    path = scratch_path(spark, "bars")
    src.write_market_dir(fx.market(spark, sf), path)
    return path


@query("a4_scan_market_dir", f"SELECT {KEY}, open, high, low, close, volume FROM fx_market", d="open high low close volume", t="trade_date")
def a4(spark, sf):
    """Every bar written to its stock's file, found there by name, typed and cleaned."""
    raw = src.scan_market_dir(spark, bar_folder(spark, sf), folders=True)
    return src.standardize_ohlcv(raw).select("stock_code", "trade_date", "open", "high", "low", "close", "volume")


@query("a7_storage_inventory", "SELECT stock_code, count(*) AS data_count, max(trade_date) AS latest_date, true AS sized FROM fx_market GROUP BY 1", i="data_count", t="latest_date")
def a7(spark, sf):
    """Rows and latest day per stock file; a file's size is at least ten characters a row."""
    inv = src.storage_inventory(spark, bar_folder(spark, sf), folders=True)
    return inv.select("stock_code", "data_count", "latest_date", (F.col("size") > 10 * F.col("data_count")).alias("sized"))


@query("a1_a2_dataset_roundtrip", f"SELECT {KEY}, close, volume FROM fx_market", d="close volume", t="trade_date")
def a1(spark, sf):
    """Bars written as a named dataset and read back."""
    base = scratch_path(spark, "datasets")
    datasets.write_dataset(fx.market(spark, sf), base, "market_daily")
    return datasets.read_dataset(spark, base, "market_daily").select("stock_code", "trade_date", "close", "volume")


@query(
    "a6_has_recent_data",
    "SELECT stock_code, max(trade_date) AS last_date, date_diff('day', max(trade_date), DATE '2001-11-02') <= 1 AS recent FROM fx_market GROUP BY 1",
    t="last_date",
)
def a6(spark, sf):
    return src.has_recent_data(fx.market(spark, sf), F.lit("2001-11-02").cast("date"))


@query(
    "a8_standardize_ohlcv",
    """SELECT stock_code, trade_date, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS r FROM (
    SELECT stock_code, trade_date, arg_min(p, {'o': p, 'q': l_quantity}) AS open, min(p) AS high, min(p) AS low, min(p) AS close,
    arg_min(l_quantity, {'o': p, 'q': l_quantity}) AS volume FROM fx_lines GROUP BY 1, 2)) WHERE r <= 120""",
    d="open high low close volume", t="trade_date",
)
def a8(spark, sf):
    """Raw text bars, several per day, as a feed would deliver them; plus rows with a bad date."""
    p = (F.col("l_extendedprice") / F.col("l_quantity")).cast("string")
    li = fx.table(spark, sf, "lineitem")
    raw = li.select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"),
        F.date_format("l_shipdate", "yyyy/MM/dd").alias("date"),
        *[p.alias(c) for c in ("open", "high", "low", "close")],
        F.col("l_quantity").cast("string").alias("volume"),
    )
    bad = raw.withColumn("date", F.lit("n/a"))
    return src.standardize_ohlcv(raw.unionByName(bad), 120)


@query("b31_zero_to_null", f"SELECT {KEY}, nullif(floor(volume / 40) * 40, 0.0::DOUBLE) AS v FROM fx_market", d="v", t="trade_date")
def b31(spark, sf):
    return fx.market(spark, sf).select("stock_code", "trade_date", zero_to_null(F.floor(F.col("volume") / 40) * 40).alias("v"))


@query(
    "g3_dedupe_by_date",
    """SELECT stock_code, trade_date, arg_min(p, k) AS price, arg_min(l_quantity, k) AS qty FROM fx_lines GROUP BY 1, 2""",
    d="price qty", t="trade_date",
)
def g3(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    rows = li.select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"), F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), *order,
    )
    return dedupe_by_date(rows, order=order).select("stock_code", "trade_date", "price", "qty")


@query("g2_distinct_dates", "SELECT DISTINCT trade_date FROM fx_lines", t="trade_date")
def g2(spark, sf):
    return panel.distinct_dates(fx.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("trade_date")))


@query("b42_price_filter", "SELECT stock_code, close AS latest_price FROM tech_latest WHERE age = 1 AND close BETWEEN 200 AND 1500", d="latest_price")
def b42(spark, sf):
    last = technical.tail_days(fx.market(spark, sf), 1).select("stock_code", F.col("close").alias("latest_price"))
    return panel.price_filter(last, 200, 1500)


@query("c14_restrict_scope", f"""SELECT {KEY}, close FROM fx_market SEMI JOIN (SELECT stock_code FROM fx_market GROUP BY 1 ORDER BY count(*) DESC, stock_code LIMIT 50) USING (stock_code)
    SEMI JOIN (SELECT DISTINCT trade_date FROM fx_market SEMI JOIN (SELECT stock_code FROM fx_market GROUP BY 1 ORDER BY count(*) DESC, stock_code LIMIT 50) USING (stock_code) ORDER BY trade_date DESC LIMIT 200) USING (trade_date)""", d="close", t="trade_date")
def c14(spark, sf):
    return panel.restrict_scope(fx.market(spark, sf).select("stock_code", "trade_date", "close"), 50, 200)


@query("f4_top_k_per_stock", f"SELECT {KEY}, volume, rank FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY volume DESC, trade_date) AS rank FROM fx_market) WHERE rank <= 3", d="volume", i="rank", t="trade_date")
def f4(spark, sf):
    return panel.top_k_per(fx.market(spark, sf), "stock_code", "volume", 3, tie="trade_date").select("stock_code", "trade_date", "volume", "rank")


@query("f1_sort_panel", f"SELECT {KEY}, close FROM fx_market ORDER BY trade_date, stock_code", d="close", t="trade_date")
def f1(spark, sf):
    return panel.sort_panel(fx.market(spark, sf).select("stock_code", "trade_date", "close"))


@query("f3_top_n", f"SELECT {KEY}, future_ret_5d FROM tech3 WHERE future_ret_5d IS NOT NULL ORDER BY future_ret_5d DESC, stock_code, trade_date LIMIT 20", d="future_ret_5d", t="trade_date")
def f3(spark, sf):
    p = technical.forward_label(fx.market(spark, sf)).select("stock_code", "trade_date", "future_ret_5d").dropna()
    return p.orderBy(F.col("future_ret_5d").desc(), "stock_code", "trade_date").limit(20)


@query("f5_top_by_abs", f"SELECT {KEY}, ret_1d FROM tech1 WHERE ret_1d IS NOT NULL ORDER BY abs(ret_1d) DESC, stock_code LIMIT 20", d="ret_1d", t="trade_date")
def f5(spark, sf):
    m = fx.market(spark, sf)
    p = m.select("stock_code", "trade_date", t.pct_change(F.col("close"), 1, t.by_stock()).alias("ret_1d")).dropna()
    return panel.top_by_abs(p, "ret_1d", 20, "stock_code")


@query("f6_head", f"SELECT {KEY}, close FROM fx_market ORDER BY trade_date, stock_code LIMIT 25", d="close", t="trade_date")
def f6(spark, sf):
    return panel.head(fx.market(spark, sf).select("stock_code", "trade_date", "close"), 25, ["trade_date", "stock_code"])
