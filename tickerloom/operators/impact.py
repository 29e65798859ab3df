"""Impact of news on stocks: sector relevance, events, decay, summaries and reports.

Items are rows of (stock_code, news_id, title, content, publish_time, sentiment, importance,
affected_sectors). weights: (sector, stock_code, weight), with stock_code 'default' as the
sector's fallback.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions import defaults
from tickerloom.functions.maths import impact_fields, round_half_up
from tickerloom.functions.timing import decay_impact

GLOBAL_DEFAULT = 0.2


def _split_weights(weights: DataFrame):
    own = weights.filter("stock_code <> 'default'").select("sector", "stock_code", F.col("weight").alias("_own"))
    base = weights.filter("stock_code = 'default'").select("sector", F.col("weight").alias("_base"))
    return own, base


def _stock_sector_weight(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """+_rel for distinct (stock_code, sector) pairs."""
    own, base = _split_weights(weights)
    return (
        pairs.join(own, ["sector", "stock_code"], "left")
        .join(base, "sector", "left")
        .select("sector", "stock_code", F.coalesce("_own", "_base", F.lit(GLOBAL_DEFAULT)).alias("_rel"))
    )


def sector_relevance(news: DataFrame, weights: DataFrame) -> DataFrame:
    """+sector_relevance: mean of weight x impact over the item's sectors, at most 1; 0.3 without.

    Weights are looked up once per distinct (stock, sector) and joined back per item sector.
    """
    keys = ["stock_code", "news_id"]
    parts = news.select(*keys, F.explode("affected_sectors").alias("sector", "_imp"))
    rel = _stock_sector_weight(parts.select("stock_code", "sector").distinct(), weights)
    score = (
        parts.join(rel, ["stock_code", "sector"])
        .groupBy(*keys)
        .agg(F.least(F.avg(F.col("_rel") * F.col("_imp")), F.lit(1.0)).alias("sector_relevance"))
    )
    return news.join(score, keys, "left").fillna(0.3, subset=["sector_relevance"])


def event_impact(news: DataFrame, weights: DataFrame, events=defaults.EVENT_FACTORS) -> DataFrame:
    """+event_impact: summed impact of the events named, scaled by the stock's best sector weight.

    The event list is short and known when the plan is built; each stock gets one factor per
    event from the weight table, so the text is only searched, never joined.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    named = sorted({s for _, _, _, sectors in events for s in sectors})
    out = news
    if named:
        stocks = news.select("stock_code").distinct()
        pairs = stocks.select("stock_code", F.explode(F.array(*[F.lit(s) for s in named])).alias("sector"))
        rel = _stock_sector_weight(pairs, weights).groupBy("stock_code").agg(
            F.map_from_entries(F.collect_list(F.struct("sector", "_rel"))).alias("_rels")
        )
        out = news.join(rel, "stock_code", "left")
    score = F.lit(0.0)
    for term, impact, _, sectors in events:
        scale = F.lit(float(impact))
        if sectors:
            best = [F.element_at("_rels", s) for s in sectors]
            scale = scale * (F.greatest(*best) if len(best) > 1 else best[0])
        score = score + F.when(text.contains(term), scale).otherwise(0.0)
    return out.withColumn("event_impact", score).drop("_rels")


def impact_duration(title: Column, imp: Column, score: Column, events=defaults.EVENT_FACTORS) -> Column:
    """Days the impact lasts: base 2, more for importance, strength and the first event named."""
    base = 2 + F.when(imp > 0.8, 3).when(imp > 0.6, 2).otherwise(0) + F.when(F.abs(score) > 0.5, 2).otherwise(0)
    named = F.lit(0)
    for term, _, days, _ in reversed(events):
        named = F.when(title.contains(term), days).otherwise(named)
    return F.least(F.greatest(base, named), F.lit(10))


def news_impact(news: DataFrame, weights: DataFrame, as_of: Column, events=defaults.EVENT_FACTORS) -> DataFrame:
    """One impact row per (stock, item)."""
    df = event_impact(sector_relevance(news, weights), weights, events)
    df = df.withColumn("time_decay", decay_impact(F.col("publish_time"), as_of))
    raw = (F.col("sentiment") * F.col("importance") * F.col("sector_relevance") + F.col("event_impact")) * F.col(
        "time_decay"
    )
    df = df.withColumn("_raw", raw)
    df = df.withColumn("_f", impact_fields(F.col("_raw")))
    return df.select(
        "stock_code",
        "news_id",
        "title",
        "publish_time",
        round_half_up(F.col("_raw"), 4).alias("impact_score"),
        F.col("_f.direction").alias("impact_direction"),
        F.col("_f.expected_change_pct").alias("expected_change_pct"),
        F.col("_f.confidence").alias("confidence"),
        round_half_up(F.col("sector_relevance"), 3).alias("sector_relevance"),
        round_half_up(F.col("time_decay"), 3).alias("time_decay"),
        impact_duration(F.coalesce("title", F.lit("")), F.col("importance"), F.col("_raw"), events).alias("duration_days"),
    )


def _units(score: Column) -> Column:
    """Scores have four places; summed as whole units the total does not depend on row order."""
    return F.round(score * 10000).cast("long")


def batch_impact_summary(impact: DataFrame) -> DataFrame:
    """Totals and overall label per stock."""
    s = F.col("impact_score")
    out = impact.groupBy("stock_code").agg(
        F.count("*").alias("total_news"),
        (F.sum(_units(s)).cast("double") / 10000.0).alias("_t"),
        F.count_if(s > 0.1).alias("positive_count"),
        F.count_if(s < -0.1).alias("negative_count"),
    )
    t = F.col("_t")
    return out.select(
        "stock_code",
        "total_news",
        round_half_up(t, 4).alias("total_impact"),
        F.when(t > 0.2, "positive").when(t < -0.2, "negative").otherwise("neutral").alias("overall_sentiment"),
        "positive_count",
        "negative_count",
        (F.col("total_news") - F.col("positive_count") - F.col("negative_count")).alias("neutral_count"),
        round_half_up(t / F.col("total_news"), 4).alias("avg_impact"),
    )


def top_impacts(impact: DataFrame, k: int = 20) -> DataFrame:
    """Strongest items per stock by absolute score."""
    w = Window.partitionBy("stock_code").orderBy(F.abs("impact_score").desc(), "news_id")
    return impact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_impacts(impact: DataFrame, order: str = "publish_time", k: int = 3) -> DataFrame:
    """First k positive and first k negative items per stock in arrival order."""
    s = F.col("impact_score")
    side = F.when(s > 0.1, "positive").when(s < -0.1, "negative")
    w = Window.partitionBy("stock_code", "side").orderBy(order, "news_id")
    return (
        impact.withColumn("side", side)
        .filter(F.col("side").isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def sector_impact_vector(news: DataFrame, as_of: Column) -> DataFrame:
    """(stock_code, sector, impact): decayed impact per sector."""
    decay = decay_impact(F.col("publish_time"), as_of)
    return (
        news.select(
            "stock_code",
            (F.col("sentiment") * F.col("importance") * decay).alias("_v"),
            F.explode("affected_sectors").alias("sector", "_w"),
        )
        .groupBy("stock_code", "sector")
        .agg(F.sum(F.col("_w") * F.col("_v")).alias("impact"))
    )


def impact_trend(impact: DataFrame, delta: float = 0.2) -> DataFrame:
    """(stock_code, trend): newer half against older half of each stock's items.

    The middle is found by distributed running counts, so a stock with most of the news is not
    sorted in one task.
    """
    from tickerloom.operators.ordered import running_total

    seconds = impact.groupBy("stock_code", F.unix_micros("publish_time").alias("_ts"), "news_id").agg(
        F.sum(_units(F.col("impact_score"))).alias("_v"), F.count("*").alias("_n")
    )
    per_time = seconds.groupBy("stock_code", "_ts").agg(F.sum("_n").alias("_n"))
    ranks = running_total(per_time, "_ts", ["_n"], by=["stock_code"]).select(
        "stock_code", "_ts", (F.col("cum__n") - F.col("_n")).alias("_older")
    )
    totals = per_time.groupBy("stock_code").agg(F.sum("_n").alias("_all"))
    # ties in time are ordered by news_id; a window over one instant of one stock is short
    w = Window.partitionBy("stock_code", "_ts").orderBy(F.col("news_id").desc())
    placed = (
        seconds.withColumn("_k", F.sum("_n").over(w))
        .join(ranks, ["stock_code", "_ts"])
        .join(totals, "stock_code")
        .withColumn("_place", F.col("_older") + F.col("_k"))
    )
    recent = F.col("_place") > F.col("_all") - F.floor(F.col("_all") / 2)
    sums = placed.groupBy("stock_code").agg(
        F.max("_all").alias("_all"),
        F.sum(F.when(recent, F.col("_v")).otherwise(0)).alias("_new"),
        F.sum(F.when(~recent, F.col("_v")).otherwise(0)).alias("_old"),
    )
    gap, limit = F.col("_new") - F.col("_old"), round(delta * 10000)
    trend = F.when(F.col("_all") < 2, "stable").when(gap > limit, "improving").when(gap < -limit, "deteriorating").otherwise("stable")
    return sums.select(
        "stock_code",
        trend.alias("trend"),
        (F.col("_new") / 10000.0).alias("recent_impact"),
        (F.col("_old") / 10000.0).alias("older_impact"),
    )


def impact_report(news: DataFrame, weights: DataFrame, as_of: Column, events=defaults.EVENT_FACTORS) -> DataFrame:
    """One report row per stock: summary, sector impact, trend, warnings, recommendation."""
    impact = news_impact(news, weights, as_of, events)
    sectors = sector_impact_vector(news, as_of)
    w = Window.partitionBy("stock_code").orderBy(F.abs("impact").desc(), "sector")
    bad = (
        sectors.filter("impact < -0.3")
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn <= 3")
        .groupBy("stock_code")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("_rn", "sector")))["sector"], ", ").alias("_bad"))
    )
    top = (
        top_impacts(impact, 5)
        .groupBy("stock_code")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "news_id", "impact_score"))).alias("top_impacts"))
    )
    vector = sectors.groupBy("stock_code").agg(F.map_from_entries(F.collect_list(F.struct("sector", "impact"))).alias("sector_impact"))
    r = (
        batch_impact_summary(impact)
        .join(impact_trend(impact).select("stock_code", "trend"), "stock_code", "left")
        .join(vector, "stock_code", "left")
        .join(top, "stock_code", "left")
        .join(bad, "stock_code", "left")
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("negative_count") > F.col("positive_count") * 2, "负面新闻数量明显多于正面新闻，需关注潜在风险"),
            F.when(F.col("total_impact") < -0.5, "综合影响分数较低，建议谨慎操作"),
            F.when(F.col("_bad").isNotNull(), F.concat(F.lit("以下领域存在较大负面影响: "), "_bad")),
        )
    )
    advice = (
        F.when((F.col("overall_sentiment") == "positive") & (F.col("total_impact") > 0.3), "新闻面整体偏正面，可适当关注")
        .when((F.col("overall_sentiment") == "negative") & (F.col("total_impact") < -0.3), "新闻面整体偏负面，建议谨慎")
        .otherwise("新闻面中性，建议结合技术面综合判断")
    )
    return r.withColumns({"risk_warnings": warnings, "recommendation": advice}).drop("_bad")
