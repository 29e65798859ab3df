"""Alignment of timestamps to per-stock trading calendars."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.timing import trade_close_ts


def effective_day(ts: Column, hour: int = 15, minute: int = 0) -> Column:
    """Calendar day of a timestamp, moved to the next day after the close."""
    day = F.to_date(ts)
    return F.when(ts > trade_close_ts(day, hour, minute), F.date_add(day, 1)).otherwise(day)


def calendar_of(market: DataFrame) -> DataFrame:
    return market.select("stock_code", "trade_date").distinct()


def _roll(days: DataFrame, calendar: DataFrame, direction: str) -> DataFrame:
    """Map distinct (stock_code, _day) to the nearest trade day at or after / before it. The calendar's own days only
    help to find it and are left behind, so what is joined afterwards goes with ``days``."""
    marks = (
        calendar.select("stock_code", F.col("trade_date").alias("_day"), F.col("trade_date").alias("_hit"), F.lit(False).alias("_asked"))
        .unionByName(days.withColumns({"_hit": F.lit(None).cast("date"), "_asked": F.lit(True)}))
        .groupBy("stock_code", "_day")
        .agg(F.max("_hit").alias("_hit"), F.max("_asked").alias("_asked"))
    )
    order = F.col("_day").desc() if direction == "next" else F.col("_day").asc()
    w = Window.partitionBy("stock_code").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("trade_date", F.last("_hit", ignorenulls=True).over(w))
    return found.filter("_asked").select("stock_code", "_day", "trade_date")


def align_news(news: DataFrame, calendar: DataFrame, hour: int = 15, minute: int = 0, ts: str = "publish_time") -> DataFrame:
    """+trade_date: first trade day of the stock whose close is at or after the timestamp.

    Only distinct (stock, day) pairs meet the calendar; the window runs on those, and the items
    pick their trade day up by an equi-join on (stock, day), where adaptive execution can split
    a hot pair. Items after the last close or without a time are dropped.
    """
    dated = news.filter(F.col(ts).isNotNull()).withColumn("_day", effective_day(F.col(ts), hour, minute))
    steps = _roll(dated.select("stock_code", "_day").distinct(), calendar, "next")
    steps = steps.filter(F.col("trade_date").isNotNull())
    return dated.join(steps, ["stock_code", "_day"]).drop("_day")


def neighbour_trade_date(df: DataFrame, calendar: DataFrame, direction: str = "next", include_current: bool = False, day: str = "day") -> DataFrame:
    """+neighbour: next or previous trade day of ``day``, optionally the day itself."""
    shift = 0 if include_current else (1 if direction == "next" else -1)
    dated = df.withColumn("_day", F.date_add(F.col(day), shift))
    steps = _roll(dated.select("stock_code", "_day").distinct(), calendar, direction)
    return dated.join(steps.withColumnRenamed("trade_date", "neighbour"), ["stock_code", "_day"], "left").drop("_day")


def sample_news_window(samples: DataFrame, calendar: DataFrame, news: DataFrame, limit: int | None = None, hour: int = 15, minute: int = 0) -> DataFrame:
    """News in (previous close, close] of each sample day, newest first.

    On a calendar day that interval is exactly what alignment assigns to the day, so the interval
    join becomes an equi-join.
    """
    used = align_news(news, calendar, hour, minute).join(
        samples.select("stock_code", "trade_date").distinct(), ["stock_code", "trade_date"], "left_semi"
    )
    w = Window.partitionBy("stock_code", "trade_date").orderBy(F.col("publish_time").desc(), "news_id")
    ranked = used.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def available_dates(df: DataFrame, limit: int = 120) -> DataFrame:
    """(stock_code, available_dates): the last ``limit`` dates of each stock as texts, oldest first, cut per task before the shuffle."""
    w = Window.partitionBy("stock_code").orderBy(F.col("trade_date").desc())
    last = df.select("stock_code", "trade_date").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return last.groupBy("stock_code").agg(F.sort_array(F.collect_list(F.date_format("trade_date", "yyyy-MM-dd"))).alias("available_dates"))


USED_FIELDS = ["publish_time", "source", "title", "sentiment", "importance"]


def used_news(aligned: DataFrame, limit: int = 20) -> DataFrame:
    """(stock_code, trade_date, used_news): the newest ``limit`` items of each sample day, newest first, cut per task before the shuffle."""
    w = Window.partitionBy("stock_code", "trade_date").orderBy(F.col("publish_time").desc(), "news_id")
    item = F.struct("_rn", *USED_FIELDS)
    first = aligned.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    in_order = F.sort_array(F.collect_list(item))
    return first.groupBy("stock_code", "trade_date").agg(F.transform(in_order, lambda x: F.struct(*[x[f].alias(f) for f in USED_FIELDS])).alias("used_news"))


def sample_replay(model: DataFrame, market: DataFrame, news_daily: DataFrame, news: DataFrame, keys: DataFrame | None = None, hour: int = 15, minute: int = 0, news_limit: int = 20, dates_limit: int = 120) -> DataFrame:
    """One audit row per sample: label, market and news rows, news window, the newest items used and a leakage check.

    With ``keys`` (stock_code, trade_date) only those samples, each with its stock's last dates; without, every sample. The
    count of used news is that of the whole window, the list holds ``news_limit`` of them.
    """
    samples = model if keys is None else model.join(keys, ["stock_code", "trade_date"], "left_semi")
    calendar = calendar_of(market)
    w = Window.partitionBy("stock_code").orderBy("trade_date")
    aligned = align_news(news, calendar, hour, minute)
    if keys is not None:
        aligned = aligned.join(keys, ["stock_code", "trade_date"], "left_semi")
    listed = used_news(aligned, news_limit)
    used = (
        align_news(news, calendar, hour, minute)
        .groupBy("stock_code", "trade_date")
        .agg(F.count("*").alias("used_news_count"), F.max("publish_time").alias("used_latest"))
    )
    totals = news.filter(F.col("publish_time").isNotNull()).groupBy("stock_code").agg(F.count("*").alias("_all"))
    windows = (
        calendar.join(used, ["stock_code", "trade_date"], "left")
        .join(totals, "stock_code", "left")
        .select(
            "stock_code",
            "trade_date",
            trade_close_ts(F.lag("trade_date").over(w), hour, minute).alias("window_start"),
            trade_close_ts(F.col("trade_date"), hour, minute).alias("window_end"),
            F.coalesce("used_news_count", F.lit(0)).alias("used_news_count"),
            "used_latest",
            (
                F.coalesce("_all", F.lit(0))
                - F.sum(F.coalesce("used_news_count", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
            ).alias("future_news_count"),
        )
    )
    keys_of = ["stock_code", "trade_date"]
    snapshot = lambda df, name: df.select(*keys_of, F.struct(*[c for c in df.columns if c not in keys_of]).alias(name))
    out = (
        samples.join(windows, keys_of, "left")
        .join(snapshot(market, "market_snapshot"), keys_of, "left")
        .join(snapshot(news_daily, "news_snapshot"), keys_of, "left")
    )
    out = out.join(listed, keys_of, "left").withColumn("used_news", F.coalesce("used_news", F.array().cast(listed.schema["used_news"].dataType)))
    if keys is not None:
        stocks = model.join(keys.select("stock_code").distinct(), "stock_code", "left_semi")
        out = out.join(available_dates(stocks, dates_limit), "stock_code", "left")
    ok = F.col("used_latest").isNull() | (F.col("used_latest") <= F.col("window_end"))
    return out.withColumn("strict_time_check_passed", ok)
