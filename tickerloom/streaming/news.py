"""Structured Streaming forms of the news operators. Event time: publish_time (timestamp)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.timing import clamp_age_hours
from tickerloom.operators.calendar import effective_day


def stream_news_dedupe(sdf: DataFrame, watermark: str = "1 day", key: str = "news_id") -> DataFrame:
    """First arrival of each id within the watermark; state older than that is dropped.

    The watermark is kept on the time of arrival, which never runs backwards, so items of any publish
    time and in any order of files pass: an item is compared with those that arrived within ``watermark`` before it.
    """
    arrived = sdf.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", watermark)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def stream_freshness(sdf: DataFrame, as_of: Column | None = None, max_age_hours=72) -> DataFrame:
    """Drop items without a time or older than the cutoff; by default relative to now."""
    hours = clamp_age_hours(max_age_hours)
    keep = F.col("publish_time").isNotNull()
    if hours is not None:
        now = F.current_timestamp() if as_of is None else as_of
        keep = keep & (F.col("publish_time") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return sdf.filter(keep)


def split_by_age(sdf: DataFrame, as_of: Column | None = None, back: str = "30 days", ahead: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(kept, aside): items published within ``back`` before and ``ahead`` after ``as_of``, and all others with a reason.

    ``as_of`` is the time of the batch, or a column such as the time of arrival. Behind this split no kept item is
    ever late for a watermark of ``back`` plus ``ahead``, as long as ``as_of`` does not run backwards, and one wrong date can
    neither push the watermark ahead nor hold state open. Items set aside (``future``, ``stale``, ``no time``) are a stream
    of their own, to be written and counted.
    """
    now = F.current_timestamp() if as_of is None else as_of
    at = F.col("publish_time")
    reason = F.when(at.isNull(), "no time").when(at > now + F.expr(f"INTERVAL {ahead}"), "future").when(at < now - F.expr(f"INTERVAL {back}"), "stale")
    marked = sdf.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def stream_daily_news(sdf: DataFrame, watermark: str = "3650 days", keys=("stock_code",)) -> DataFrame:
    """Counts and means per stock and day bucket (previous 15:00, 15:00].

    Windows are closed on the left, so event time is moved by a microsecond to close them on the right, and the
    watermark stands on the moved time: the state of a bucket goes once the latest item is ``watermark`` past its end.
    An item for such a bucket comes too late and is not counted; ``split_by_age`` before this keeps items from being late, and
    the watermark from being moved by a wrong date.
    """
    moved = F.col("publish_time") - F.expr("INTERVAL 0.000001 SECOND")
    return (
        sdf.withColumn("_moved", moved)
        .withWatermark("_moved", watermark)
        .groupBy(*keys, F.window("_moved", "1 day", "1 day", "15 hours").alias("w"))
        .agg(
            F.count("*").alias("news_count"),
            F.avg("sentiment").alias("avg_sentiment"),
            F.sum(F.abs("sentiment")).alias("news_sentiment_abs_sum"),
        )
        .select(*keys, F.col("w.end").alias("close_ts"), "news_count", "avg_sentiment", "news_sentiment_abs_sum")
    )


BLOCK = 32  # calendar days that one row of the static side answers for


def _block(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BLOCK)


def effective_days(calendar: DataFrame) -> DataFrame:
    """(stock_code, block, days, next_day, first_day), the static side: for every block of days from a stock's first trade day to its
    last the trade days of the first block at or after it that has any, and the first one beyond that block."""
    days = calendar.select("stock_code", F.col("trade_date").cast("date").alias("_day")).filter("_day is not null")
    held = days.groupBy("stock_code", _block(F.col("_day")).alias("_at")).agg(F.sort_array(F.collect_set("_day")).alias("days"))
    w = Window.partitionBy("stock_code").orderBy("_at")
    first = F.col("days")[0]
    near = {"_from": F.coalesce(F.lag("_at").over(w) + 1, F.col("_at")), "next_day": F.lead(first).over(w), "first_day": F.first(first).over(w)}
    return held.withColumns(near).select("stock_code", F.explode(F.sequence("_from", "_at")).alias("block"), "days", "next_day", "first_day")


def stream_effective_day(sdf: DataFrame, days: DataFrame, hour: int = 15, minute: int = 0) -> DataFrame:
    """+trade_date by stream-static equi-joins; late news moves to the next day, items before a stock's first trade day move
    to that day. Items after its last trade day, without a time or of an unknown stock stay, with a NULL trade_date."""
    first = days.groupBy("stock_code").agg(F.min("first_day").alias("_first"))
    dated = sdf.join(first, "stock_code", "left").withColumn("_day", F.greatest(effective_day(F.col("publish_time"), hour, minute), F.col("_first")))
    dated = dated.withColumn("_day", F.when(F.col("publish_time").isNotNull(), F.col("_day"))).withColumn("block", _block(F.col("_day")))
    found = dated.join(days.drop("first_day"), ["stock_code", "block"], "left")
    hit = F.coalesce(F.array_min(F.filter("days", lambda d: d >= F.col("_day"))), F.col("next_day"))
    return found.withColumn("trade_date", hit).drop("block", "_first", "_day", "days", "next_day")


def stream_shock_alert(sdf: DataFrame, watermark: str = "3650 days") -> DataFrame:
    """Day buckets, to be run in update mode: a bucket changes with each batch, so ``shock_rows`` picks
    the alerts from the latest state of each bucket, not from what was emitted on the way."""
    return stream_daily_news(sdf, watermark)


def shock_rows(latest: DataFrame, min_count: int = 8, min_sent: float = 0.45) -> DataFrame:
    """Buckets with many items or strong mean sentiment."""
    return latest.filter((F.col("news_count") >= min_count) | (F.abs("avg_sentiment") >= min_sent))
