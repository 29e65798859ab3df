"""Technical indicators, forward labels and the serving-time snapshot."""

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.functions import technical as t
from tickerloom.functions.maths import ratio, safe_float, zero_to_null
from tickerloom.operators.ewm import ewm


def technical_panel(bars: DataFrame, horizon: int = 5, threshold: float = 0.01, fill: bool = True, label: bool = True) -> DataFrame:
    """Add the 11 technical columns and, if asked, future_ret_5d and label_up_5d."""
    w = t.by_stock()
    df = bars.withColumns({"_c": zero_to_null(F.col("close")), "_v": zero_to_null(F.col("volume"))})
    df = df.withColumn("_f", t.forward_fill(F.col("_c"), w) if fill else F.col("_c"))
    c, f = F.col("_c"), F.col("_f")
    df = df.withColumns(
        {
            "ret_1d": t.pct_change(f, 1, w),
            "ret_5d": t.pct_change(f, 5, w),
            "ret_20d": t.pct_change(f, 20, w),
            "_d": c - F.lag(c, 1).over(w),
        }
    )
    df = df.withColumns(
        {
            "vol_5d": t.rolling_std(F.col("ret_1d"), 5, w),
            "vol_20d": t.rolling_std(F.col("ret_1d"), 20, w),
            "rsi": t.rsi(F.col("_d"), 14, w),
            "bb_position": t.bollinger_position(c, 20, w),
            "ma5_gt_ma10": t.ma_cross(c, 5, 10, w),
            "ma10_gt_ma20": t.ma_cross(c, 10, 20, w),
            "volume_ratio": t.volume_ratio(F.col("_v"), 20, w),
        }
    )
    if label:
        df = forward_label(df, "_c", horizon, threshold)
    df = ewm(df, {"_c": [("_fast", 12), ("_slow", 26)]})
    df = df.withColumn("macd", (F.col("_fast") - F.col("_slow")) / F.col("_c"))
    return df.drop("_c", "_v", "_f", "_d", "_fast", "_slow")


def forward_label(df: DataFrame, price: str = "close", horizon: int = 5, threshold: float = 0.01) -> DataFrame:
    """+future_ret_5d, label_up_5d (strictly above the threshold, NULL when unknown)."""
    ahead = F.lead(price, horizon).over(t.by_stock())
    df = df.withColumn("future_ret_5d", F.try_divide(ahead, F.col(price)) - 1.0)
    return df.withColumn("label_up_5d", (F.col("future_ret_5d") > threshold).cast("double"))


def min_history(df: DataFrame, n: int, key: str = "stock_code") -> DataFrame:
    """Keep stocks with at least n rows."""
    rows = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_rows", rows).filter(F.col("_rows") >= n).drop("_rows")


def tail_days(df: DataFrame, n: int, key: str = "stock_code", day: str = "trade_date") -> DataFrame:
    """Last n rows of each stock."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def recent_history(df: DataFrame, days: int, least: int, key: str = "stock_code", day: str = "trade_date") -> DataFrame:
    """``min_history(tail_days(df, days), least)`` in the order by day that the indicators use, so no sort of its own."""
    rows = F.count("*").over(Window.partitionBy(key))
    left = rows - F.row_number().over(Window.partitionBy(key).orderBy(day))
    numbered = df.withColumns({"_rows": rows, "_left": left})
    return numbered.filter((F.col("_left") < days) & (F.least("_rows", F.lit(days)) >= least)).drop("_rows", "_left")


def latest_and_previous(df: DataFrame, key: str = "stock_code", day: str = "trade_date") -> DataFrame:
    """Last two rows of each stock, age 1 and 2."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    return df.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= 2)


def last_dates(df: DataFrame, n: int = 60, key: str = "stock_code", day: str = "trade_date") -> DataFrame:
    """Ascending array of the last n dates of each stock."""
    recent = tail_days(df.select(key, day).distinct(), n, key, day)
    return recent.groupBy(key).agg(F.sort_array(F.collect_list(day)).alias("dates"))


def stock_price_stats(market: DataFrame, days: int) -> DataFrame:
    """Current price, change, extremes and volume over the last ``days`` rows of each stock."""
    recent = tail_days(market, days)
    w = Window.partitionBy("stock_code").orderBy("trade_date")
    recent = recent.withColumn("_prev", F.lag("close").over(w))
    s = recent.groupBy("stock_code").agg(
        F.max_by("close", "trade_date").alias("current"),
        F.max_by(F.coalesce("_prev", "close"), "trade_date").alias("_prev"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.avg("volume").alias("avg_volume"),
        F.count("*").alias("days"),
    )
    change = ratio((F.col("current") - F.col("_prev")) * 100.0, F.col("_prev"))
    return s.withColumn("change", change).drop("_prev")


SNAPSHOT_NAMES = (
    "ret_5", "ret_20", "vol_5", "vol_20", "rsi", "macd", "bb_position", "volume_ratio",
    "price_position", "ma_trend", "ma_gap", "momentum_10",
)


SNAPSHOT_REACH = 64  # rows at the end of a stock that its snapshot's windows look at: 60 for the place of the price


def tech_snapshot(bars: DataFrame) -> DataFrame:
    """(stock_code, tech array(12), latest_price, n_rows) from the last bar of each stock.

    Serving-time definitions: "5-day" spans four steps, values are in percent, all zero below 20
    rows. Separate from the training columns on purpose.
    """
    w = t.by_stock()
    c, n = F.col("close"), F.count("*").over(Window.partitionBy("stock_code"))
    df = bars.select("stock_code", "trade_date", "close", "volume", t.forward_fill(c, w).alias("_f"), n.alias("_n"), (n - F.row_number().over(w)).alias("_left"))
    # the means run over the whole history; what the other windows of the last bar reach is kept for them
    df = ewm(df, {"close": [("_fast", 12), ("_slow", 26)]}).filter(F.col("_left") < SNAPSHOT_REACH)
    df = df.withColumns(
        {
            "_r": t.pct_change(F.col("_f"), 1, w),
            "_d": c - F.lag(c, 1).over(w),
            "_m10": t.pct_change(F.col("_f"), 10, w) * 100.0,
            "_l4": t.pct_change(c, 4, w) * 100.0,
            "_l19": t.pct_change(c, 19, w) * 100.0,
            "_ma5": t.rolling_mean(c, 5, w),
            "_ma10": t.rolling_mean(c, 10, w),
            "_ma20": t.rolling_mean(c, 20, w),
            "_vm": F.avg("volume").over(t.back(w, 20)),
            "_pp": t.price_position(c, 60, w),
            "_bb": t.bollinger_position(c, 20, w),
        }
    )
    df = df.withColumns(
        {
            "_s5": F.stddev_samp("_r").over(t.back(w, 5)) * 100.0,
            "_s20": F.stddev_samp("_r").over(t.back(w, 20)) * 100.0,
            "_rsi": t.rsi(F.col("_d"), 14, w),
        }
    ).filter(F.col("_left") == 0)
    trend = F.when((F.col("_ma5") > F.col("_ma10")) & (F.col("_ma10") > F.col("_ma20")), 1.0).otherwise(-1.0)
    vr = F.when(
        F.col("_vm") > 0, F.least(safe_float(F.col("volume") / F.col("_vm") / 5.0, 0.2), F.lit(1.0))
    ).otherwise(0.0)
    values = F.array(
        safe_float(F.col("_l4")),
        safe_float(F.col("_l19")),
        safe_float(F.col("_s5")),
        safe_float(F.col("_s20")),
        safe_float(F.col("_rsi"), 0.5),
        safe_float(F.try_divide(F.col("_fast") - F.col("_slow"), c) * 100.0),
        safe_float(F.col("_bb"), 0.5),
        vr,
        safe_float(F.col("_pp"), 0.5),
        trend,
        safe_float(F.try_divide(F.col("_ma5") - F.col("_ma20"), F.col("_ma20")) * 100.0),
        safe_float(F.col("_m10")),
    )
    zeros = F.array_repeat(F.lit(0.0), 12)
    return df.select(
        "stock_code",
        F.when(F.col("_n") >= 20, values).otherwise(zeros).alias("tech"),
        F.col("close").alias("latest_price"),
        F.col("_n").alias("n_rows"),
    )
