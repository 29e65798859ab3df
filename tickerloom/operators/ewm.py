"""Exponentially weighted means by window functions."""

import math

from pyspark.sql import DataFrame, Window, functions as F

REACH, LEAST = 600.0, 100.0  # log weight that a segment spans, for the fastest and at least for the slowest span that shares it


def _fall(span: float, gap: float) -> float:
    """Log weight that the past loses at a value after ``gap`` rows: ln(1 + alpha / r^gap)."""
    alpha = 2.0 / (span + 1.0)
    x = math.log(alpha) - gap * math.log(1.0 - alpha)
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def _share(fast: float, slow: float) -> bool:
    """Whether segments cut for ``fast`` leave ``slow`` no weight beyond two of them, whatever the gaps."""
    return all(_fall(slow, 1.02**k) * REACH >= _fall(fast, 1.02**k) * LEAST for k in range(500))


def ewm(df: DataFrame, spans: dict, key: str = "stock_code", order: str = "trade_date") -> DataFrame:
    """Add adjust=False exponential means; ``spans`` is {column: [(output, span), ...]}.

    The recursion y = a*y' + b*x is linear. Rows are cut into segments over which the product of a falls
    by exp(-REACH); inside a segment y is a running sum of b*x scaled by the running product of a, which
    neither overflows nor vanishes there. What enters a segment is the end of the one before it; what lies further back
    has no weight left. A NULL keeps the last mean and, as time passes, weakens it: after a gap of g rows
    a = r^g / (r^g + alpha). No list is built and nothing is copied from row to row. Spans of a column that are not too far
    apart share the segments of the fastest one, so all of them need one sort besides that by ``order``.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({"_pos": F.row_number().over(w), **{f"_x0_{c}": F.first(c, ignorenulls=True).over(upto) for c in spans}})
    gaps = {}
    for c in spans:
        valid = F.when(F.col(c).isNotNull(), F.col("_pos"))
        gaps[f"_gap_{c}"] = F.col("_pos") - F.coalesce(F.last(valid, ignorenulls=True).over(before), F.col("_pos") - 1)
    out = out.withColumns(gaps)
    jobs = [(c, name, float(span)) for c, outs in spans.items() for name, span in outs]
    gain = {}
    for c, n, span in jobs:
        if span <= 1:
            raise ValueError("a span must be above 1")
        alpha = 2.0 / (span + 1.0)
        log_past = F.col(f"_gap_{c}") * math.log(1.0 - alpha)
        total, seen = F.exp(log_past) + alpha, F.col(c).isNotNull()
        gain[f"_la_{n}"] = F.when(seen, log_past - F.log(total)).otherwise(0.0)
        gain[f"_bx_{n}"] = F.when(seen, alpha / total * F.col(c)).otherwise(0.0)
    out = out.withColumns(gain)
    classes: list[list] = []
    for job in sorted(jobs, key=lambda j: (list(spans).index(j[0]), j[2])):
        if not classes or classes[-1][0][0] != job[0] or not _share(classes[-1][0][2], job[2]):
            classes.append([])
        classes[-1].append(job)
    out = out.withColumns({f"_cut_{k}": F.floor(-F.sum(f"_la_{members[0][1]}").over(upto) / REACH) for k, members in enumerate(classes)})
    spent = ["_pos", *gaps]
    for k, members in enumerate(classes):
        cut = f"_cut_{k}"
        here = Window.partitionBy(key, cut).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # the order by segment and day is that by day; written so, the sort of ``here`` serves
        along = Window.partitionBy(key).orderBy(cut, order)
        names = [n for _, n, _ in members]
        # the first row's own factor can be as small as it likes, so it stays out of the scaled sum
        out = out.withColumns({f"_lf_{n}": F.first(f"_la_{n}").over(here) for n in names})
        out = out.withColumns({f"_p_{n}": F.sum(f"_la_{n}").over(here) - F.col(f"_lf_{n}") for n in names})
        out = out.withColumns({f"_s_{n}": F.exp(f"_p_{n}") * F.sum(F.col(f"_bx_{n}") * F.exp(-F.col(f"_p_{n}"))).over(here) for n in names})
        out = out.withColumns({f"_a_{n}": F.exp(F.col(f"_lf_{n}") + F.col(f"_p_{n}")) for n in names})
        end = lambda c, n: F.col(f"_s_{n}") + F.col(f"_a_{n}") * F.col(f"_x0_{c}")
        out = out.withColumns({f"_in_{n}": F.when(F.lag(cut).over(along) != F.col(cut), F.lag(end(c, n)).over(along)) for c, n, _ in members})
        # the end of the segment before stands at the first row of each segment
        entered = lambda n: F.last(f"_in_{n}", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumns({f"_en_{n}": entered(n) for n in names})
        value = lambda c, n: F.col(f"_s_{n}") + F.col(f"_a_{n}") * F.coalesce(f"_en_{n}", f"_x0_{c}")
        out = out.withColumns({n: F.when(F.col(f"_x0_{c}").isNotNull(), value(c, n)) for c, n, _ in members})
        out = out.drop(cut, *[f"_{part}_{n}" for part in ("la", "bx", "lf", "p", "s", "a", "in", "en") for n in names])
    return out.drop(*spent).select(*df.columns, *[n for _, n, _ in jobs])


DENSE_REACH, LEAST_REACH = 500.0, 40.0  # log weight that a block spans, for the fastest and the slowest span in it


def dense_ewm(df: DataFrame, spans: dict, key: str = "stock_code", order: str = "trade_date") -> DataFrame:
    """``ewm`` for columns without NULLs (one raises an error), all outputs over the same two sorts.

    Without gaps every step weakens the past by the same factor, so blocks of rows are cut by position alone and are
    the same for all columns. A block is as long as the fastest span allows for a running sum that does not overflow;
    the slowest one in it still loses all weight (exp(-40)) over a block, so only the end of the block before
    enters. Spans too far apart for that (beyond about 12 times) get blocks of their own.
    """
    jobs = [(c, name, float(span)) for c, outs in spans.items() for name, span in outs]
    if any(span <= 1 for *_, span in jobs):
        raise ValueError("a span must be above 1")
    rate = lambda span: -math.log(1.0 - 2.0 / (span + 1.0))
    classes: list[list] = []
    for job in sorted(jobs, key=lambda j: j[2]):
        if not classes or rate(job[2]) * DENSE_REACH < rate(classes[-1][0][2]) * LEAST_REACH:
            classes.append([])
        classes[-1].append(job)
    w = Window.partitionBy(key).orderBy(order)
    value = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} holds a NULL")).cast("double")).otherwise(F.col(c))
    out = df.withColumns({"_pos": F.row_number().over(w) - 1, **{f"_x0_{c}": F.first(c).over(w) for c in spans}})
    for k, members in enumerate(classes):
        rows = max(1, int(DENSE_REACH / rate(members[0][2])))
        block, place = f"_block_{k}", F.col("_pos") % rows
        out = out.withColumn(block, F.floor(F.col("_pos") / rows))
        here = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = Window.partitionBy(key).orderBy(block, order).rowsBetween(Window.unboundedPreceding, -1)
        sums, ends, result = {}, {}, {}
        for c, n, span in members:
            alpha, r = 2.0 / (span + 1.0), rate(span)
            sums[f"_s_{n}"] = F.exp(-r * place) * F.sum(alpha * value(c) * F.exp(r * place)).over(here)
            end = F.when(place == rows - 1, F.col(f"_s_{n}") + F.exp(-r * (place + 1)) * F.col(f"_x0_{c}"))
            ends[f"_in_{n}"] = F.last(end, ignorenulls=True).over(earlier)
            result[n] = F.col(f"_s_{n}") + F.exp(-r * (place + 1)) * F.coalesce(f"_in_{n}", f"_x0_{c}")
        out = out.withColumns(sums).withColumns(ends).withColumns(result)
    return out.select(*df.columns, *[n for _, n, _ in jobs])


def macd(df: DataFrame, price: str = "close", fast: int = 12, slow: int = 26, key="stock_code", order="trade_date") -> DataFrame:
    """+macd: difference of two means relative to the price."""
    e = ewm(df, {price: [("_fast", fast), ("_slow", slow)]}, key, order)
    return e.withColumn("macd", F.try_divide(F.col("_fast") - F.col("_slow"), F.col(price))).drop("_fast", "_slow")
