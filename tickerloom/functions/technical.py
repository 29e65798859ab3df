"""Window expressions over one stock's daily bars.

Every function takes a window ordered by day and partitioned by stock, so all of them share one
shuffle and one sort. Bars are unique per (stock, day), which bounds a partition by the length
of the trading calendar however many trades or news items the stock has.
"""

from pyspark.sql import Column, Window, WindowSpec, functions as F


def by_stock(key: str = "stock_code", day: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(day)


def back(w: WindowSpec, n: int) -> WindowSpec:
    """Frame of the last n rows."""
    return w.rowsBetween(-(n - 1), Window.currentRow)


def full(value: Column, c: Column, frame: WindowSpec, n: int) -> Column:
    """NULL until the frame holds n non-NULL values."""
    return F.when(F.count(c).over(frame) == n, value)


def forward_fill(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def pct_change(c: Column, n: int, w: WindowSpec) -> Column:
    """c / c n rows ago - 1; pass a forward-filled column to bridge gaps."""
    return F.try_divide(c, F.lag(c, n).over(w)) - 1.0


def rolling_mean(c: Column, n: int, w: WindowSpec) -> Column:
    f = back(w, n)
    return full(F.avg(c).over(f), c, f, n)


def rolling_std(c: Column, n: int, w: WindowSpec) -> Column:
    f = back(w, n)
    return full(F.stddev_samp(c).over(f), c, f, n)


def rsi(delta: Column, n: int, w: WindowSpec) -> Column:
    """Simple-mean RSI in [0, 1] from the daily difference; a missing difference counts as 0."""
    f = back(w, n)
    gain = F.avg(F.coalesce(F.greatest(delta, F.lit(0.0)), F.lit(0.0))).over(f)
    loss = F.avg(F.coalesce(F.greatest(-delta, F.lit(0.0)), F.lit(0.0))).over(f)
    value = (100.0 - 100.0 / (1.0 + gain / (loss + 1e-10))) / 100.0
    return F.when(F.row_number().over(w) >= n, value)


def bollinger_position(c: Column, n: int, w: WindowSpec, k: float = 2.0) -> Column:
    mid, sd = rolling_mean(c, n, w), rolling_std(c, n, w)
    return (c - (mid - k * sd)) / (2 * k * sd + 1e-10)


def ma_cross(c: Column, fast: int, slow: int, w: WindowSpec) -> Column:
    """1.0 when the fast mean is above the slow one, else 0.0 (also while warming up)."""
    above = rolling_mean(c, fast, w) > rolling_mean(c, slow, w)
    return F.coalesce(above, F.lit(False)).cast("double")


def volume_ratio(v: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(v, rolling_mean(v, n, w))


def price_position(c: Column, n: int, w: WindowSpec) -> Column:
    """Place of the value between the low and high of the last n rows, 0.5 if flat."""
    f = back(w, n)
    lo, hi = F.min(c).over(f), F.max(c).over(f)
    return F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(0.5)


def change_pct(c: Column, w: WindowSpec) -> Column:
    return 100.0 * pct_change(c, 1, w)
