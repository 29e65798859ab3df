"""Daily top-N strategy on a scored panel, costs, equity curve and summary.

Selection happens on the panel (top-k per day, cut map-side); everything after it works on one
row per day.
"""

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.functions.maths import trade_cost
from tickerloom.operators.panel import top_k_per


def daily_topn(df: DataFrame, day: str = "trade_date", score: str = "pred_prob", n: int = 20) -> DataFrame:
    return top_k_per(df, day, score, max(1, n))


def _days() -> Window:
    return Window.partitionBy().orderBy("trade_date")


def turnover(picks: DataFrame, day: str = "trade_date") -> DataFrame:
    """(day, codes, turnover, is_first): half the codes that entered or left, per code held."""
    per = picks.groupBy(day).agg(F.sort_array(F.collect_set("stock_code")).alias("codes"))
    w = Window.partitionBy().orderBy(day)
    per = per.withColumn("_prev", F.lag("codes").over(w))
    moved = F.size(F.array_except("codes", "_prev")) + F.size(F.array_except("_prev", "codes"))
    return per.select(
        day,
        "codes",
        F.when(F.col("_prev").isNull(), 1.0).otherwise(moved / 2.0 / F.size("codes")).alias("turnover"),
        F.col("_prev").isNull().alias("is_first"),
    )


def nav(curve: DataFrame, day: str = "trade_date", ret: str = "net_return") -> DataFrame:
    w = Window.partitionBy().orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("nav", F.product(1.0 + F.col(ret)).over(w))


def drawdown(curve: DataFrame, day: str = "trade_date") -> DataFrame:
    """nav against its running peak, which starts at 1."""
    w = Window.partitionBy().orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1.0)


def holdings(picks: DataFrame, score: str = "pred_prob", ret: str = "future_ret_5d", label: str = "label_up_5d", commission=0.0003, stamp=0.001, slippage=0.0002) -> DataFrame:
    """One row per day: codes, returns, turnover and cost."""
    stats = picks.groupBy("trade_date").agg(
        F.count("*").alias("selected_count"),
        F.avg(score).alias("avg_probability"),
        F.avg(ret).alias("raw_return"),
        F.avg(F.col(label).cast("double")).alias("avg_label"),
    )
    out = stats.join(turnover(picks), "trade_date")
    cost = trade_cost(F.col("turnover"), F.col("is_first"), commission, stamp, slippage)
    return out.withColumn("trade_cost", cost).withColumn("net_return", F.col("raw_return") - F.col("trade_cost"))


def backtest_summary(curve: DataFrame, hold_days: int = 5) -> DataFrame:
    """Return, risk and cost figures of a curve with net_return, trade_cost, turnover, drawdown."""
    per_year = 252.0 / max(float(hold_days), 1.0)
    s = curve.agg(
        F.count("*").alias("periods"),
        F.coalesce(F.product(1.0 + F.col("net_return")) - 1.0, F.lit(0.0)).alias("cumulative_return"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.avg((F.col("net_return") > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg("net_return"), F.lit(0.0)).alias("avg_period_return"),
        F.coalesce(F.avg("trade_cost"), F.lit(0.0)).alias("avg_trade_cost"),
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_turnover"),
        F.stddev_pop("net_return").alias("_sd"),
    )
    grown = 1.0 + F.col("cumulative_return")
    annual = F.when((F.col("periods") > 0) & (grown > 0), F.pow(grown, per_year / F.col("periods")) - 1.0).otherwise(0.0)
    sharpe = F.when(
        (F.col("periods") > 1) & (F.col("_sd") > 1e-12),
        F.col("avg_period_return") / F.col("_sd") * per_year**0.5,
    ).otherwise(0.0)
    return s.withColumns({"annualized_return": annual, "sharpe_like": sharpe}).drop("_sd")


def sector_distribution(picks: DataFrame, sector_cols) -> DataFrame:
    """(sector, share): mean over days of the mean sector flag of the picks."""
    daily = picks.groupBy("trade_date").agg(*[F.avg(c).alias(c) for c in sector_cols])
    means = daily.agg(*[F.avg(c).alias(c) for c in sector_cols])
    rows = [F.struct(F.lit(c.replace("stock_sector_", "")).alias("sector"), F.col(c).alias("share")) for c in sector_cols]
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cross_section_backtest(scored: DataFrame, top_n: int = 20, hold_days: int = 5, score: str = "pred_prob", commission=0.0003, stamp=0.001, slippage=0.0002) -> dict[str, DataFrame]:
    """holdings, curve, summary and sectors of the daily top-N strategy."""
    picks = daily_topn(scored, "trade_date", score, top_n)
    held = holdings(picks, score, commission=commission, stamp=stamp, slippage=slippage)
    curve = drawdown(nav(held))
    sector_cols = [c for c in scored.columns if c.startswith("stock_sector_")]
    out = {"holdings": held, "curve": curve, "summary": backtest_summary(curve, hold_days)}
    if sector_cols:
        out["sectors"] = sector_distribution(picks, sector_cols)
    return out
