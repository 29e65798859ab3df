"""Column expressions for timestamps, trading closes and time decay."""

import math

from pyspark.sql import Column, DataFrame, functions as F

TIMESTAMP_FORMATS = (
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "yyyy年MM月dd日 HH:mm",
    "yyyy年MM月dd日",
    "dd MMM yyyy HH:mm:ss Z",
)


def parse_timestamp(c: Column, formats=TIMESTAMP_FORMATS) -> Column:
    """Timestamp in the session zone, NULL when no format fits."""
    text = F.trim(c.cast("string"))
    rest = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    tries = [F.try_to_timestamp(rest, F.lit(f)) for f in formats]
    return F.coalesce(text.try_cast("timestamp"), *tries)


def trade_close_ts(day: Column, hour: int = 15, minute: int = 0) -> Column:
    """Close of a trade day."""
    return day.cast("date").cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(hour), F.lit(minute), F.lit(0)
    )


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def _half_life(hours: Column, half_life: float) -> Column:
    return F.exp(-hours * F.lit(math.log(2) / half_life))


def decay_dataset(ts: Column, close_ts: Column, half_life: float = 24.0) -> Column:
    """Decay to the close, within [0.01, 1]; 0.5 for a missing time."""
    h = F.greatest(hours_between(ts, close_ts), F.lit(0.0))
    w = F.greatest(F.lit(0.01), F.least(F.lit(1.0), _half_life(h, max(half_life, 1.0))))
    return F.when(ts.isNull(), 0.5).when(close_ts.isNull(), 1.0).otherwise(w)


def decay_impact(ts: Column, as_of: Column, half_life: float = 24.0) -> Column:
    """Decay to ``as_of``, within [0.1, 1]; 0.5 for a missing time."""
    w = F.greatest(F.lit(0.1), F.least(F.lit(1.0), _half_life(hours_between(ts, as_of), half_life)))
    return F.when(ts.isNull(), 0.5).otherwise(w)


def decay_encode(ts: Column, as_of: Column) -> Column:
    """exp(-hours/24), unbounded; 0.5 for a missing time."""
    return F.when(ts.isNull(), 0.5).otherwise(F.exp(-hours_between(ts, as_of) / 24.0))


def listing_days(trade_date: Column, listing_date: Column) -> Column:
    return F.datediff(trade_date, listing_date).cast("double")


def bucket_30m(ts: Column) -> Column:
    """Floor to half an hour."""
    minutes = F.when(F.minute(ts) >= 30, 30).otherwise(0)
    return F.date_trunc("hour", ts) + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def clamp_age_hours(max_age_hours) -> int | None:
    """Whole hours of a cutoff; None or <= 0 means none."""
    if max_age_hours is None:
        return None
    hours = int(float(max_age_hours))
    return None if hours <= 0 else hours


def freshness_filter(df: DataFrame, as_of: Column, max_age_hours=72, ts: str = "publish_time") -> DataFrame:
    """Drop rows without a time or older than the cutoff."""
    hours = clamp_age_hours(max_age_hours)
    keep = F.col(ts).isNotNull()
    if hours is not None:
        keep = keep & (F.col(ts) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return df.filter(keep)
