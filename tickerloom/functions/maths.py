"""Numeric, array and rule expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F


def safe_float(c: Column, default: float = 0.0) -> Column:
    """Double, with NULL, NaN and infinities replaced."""
    d = c.try_cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(d)


def zero_to_null(c: Column) -> Column:
    return F.nullif(c.cast("double"), F.lit(0.0))


def clip(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def round_half_up(c: Column, n: int) -> Column:
    """Round half away from zero by floor, the same in every engine."""
    p = F.lit(10.0**n)
    return F.signum(c) * F.floor(F.abs(c) * p + 0.5) / p


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default when b is zero or NULL."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def fit_width(v: Column, n: int) -> Column:
    """Cut or zero-pad an array to n."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def json_list_decode(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def set_ops(a: Column, b: Column) -> Column:
    """Common, one-sided and united elements of two arrays, each sorted."""
    return F.struct(
        F.array_sort(F.array_intersect(a, b)).alias("both"),
        F.array_sort(F.array_except(a, b)).alias("only_a"),
        F.array_sort(F.array_except(b, a)).alias("only_b"),
        F.array_sort(F.array_union(a, b)).alias("either"),
    )


def return_target(target: Column, label: Column, limit: float = 0.35) -> Column:
    """Regression target: NULL falls back to +-1 % by label, NaN/inf to 0, then clipped."""
    fallback = F.when(label > 0, 0.01).otherwise(-0.01)
    return clip(F.when(target.isNull(), fallback).otherwise(safe_float(target)), -limit, limit)


def impact_fields(score: Column) -> Column:
    """Direction, expected change in percent and confidence of an impact score."""
    return F.struct(
        F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral").alias("direction"),
        round_half_up(F.abs(score) * 5, 2).alias("expected_change_pct"),
        round_half_up(F.least(F.abs(score) * 2, F.lit(1.0)), 2).alias("confidence"),
    )


def expected_return(prob: Column, predicted_return: Column, vol20_pct: Column) -> Column:
    """Expected return in percent, from the regression head or from probability and volatility."""
    vol = F.abs(vol20_pct)
    cap = clip(F.greatest(vol * 2.8, F.lit(6.0)), 6.0, 45.0)
    fallback = F.tanh((prob - 0.5) * 3.8) * clip(vol * 1.8, 0.8, 12.0)
    fallback = F.greatest(-cap, F.least(cap, fallback))
    return F.struct(
        F.when(predicted_return.isNotNull(), clip(predicted_return * 100.0, -35.0, 35.0))
        .otherwise(fallback)
        .alias("pct"),
        F.when(predicted_return.isNotNull(), "regression_head")
        .otherwise("probability_volatility_fallback")
        .alias("source"),
    )


def trade_cost(turnover: Column, is_first: Column, commission=0.0003, stamp=0.001, slippage=0.0002) -> Column:
    """One-sided cost on the first day, both sides plus stamp duty afterwards."""
    side = commission + slippage
    return F.when(is_first, F.lit(side)).otherwise(turnover * F.lit(side + side + stamp))
