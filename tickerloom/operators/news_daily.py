"""Daily news features per (stock_code, trade_date).

Inputs are items already aligned to a trade day. Every aggregate is partial-aggregated before it
shuffles, so a stock or day with most of the news costs no more than its share of rows.
"""

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.functions import defaults
from tickerloom.functions.maths import ratio, safe_float
from tickerloom.functions.timing import decay_dataset, trade_close_ts
from tickerloom.operators.ewm import dense_ewm

KEYS = ["stock_code", "trade_date"]


def _scored(aligned: DataFrame, hour: int = 15, minute: int = 0) -> DataFrame:
    close = trade_close_ts(F.col("trade_date"), hour, minute)
    return aligned.withColumns(
        {
            "_s": safe_float(F.col("sentiment")),
            "_i": safe_float(F.col("importance")),
            "_w": decay_dataset(F.col("publish_time"), close),
        }
    )


def _base_aggs():
    s, i, w = F.col("_s"), F.col("_i"), F.col("_w")
    weighted = F.when(F.sum(w) > 1e-8, F.sum(s * w) / F.sum(w)).otherwise(F.avg(s))
    return [
        F.count("*").alias("news_count"),
        F.avg(s).alias("avg_sentiment"),
        weighted.alias("weighted_sentiment"),
        F.avg(i).alias("avg_importance"),
        F.max(i).alias("max_importance"),
        F.avg((s > 0.2).cast("double")).alias("positive_ratio"),
        F.avg((s < -0.2).cast("double")).alias("negative_ratio"),
        F.sum(F.abs(s)).alias("news_sentiment_abs_sum"),
    ]


def _event_aggs(events: dict):
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return [
        F.sum(F.when(text.contains(term), 1.0).otherwise(0.0)).alias(f"event_{name}_count")
        for term, name in events.items()
    ]


def _on_calendar(calendar: DataFrame, stats: DataFrame) -> DataFrame:
    return calendar.select(*KEYS).join(stats, KEYS, "left").fillna(0)


def news_daily_base(aligned: DataFrame, calendar: DataFrame, hour: int = 15, minute: int = 0) -> DataFrame:
    """Counts, means and ratios; a zero row for calendar days without news."""
    return _on_calendar(calendar, _scored(aligned, hour, minute).groupBy(*KEYS).agg(*_base_aggs()))


def source_stats(aligned: DataFrame) -> DataFrame:
    """Number of distinct sources and their normalized entropy."""
    name = F.trim(F.coalesce("source", F.lit("")))
    per = aligned.filter(name != "").groupBy(*KEYS, name.alias("_src")).agg(F.count("*").alias("_n"))
    total = per.groupBy(*KEYS).agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    p = F.col("_n") / F.col("_t")
    return (
        per.join(total, KEYS)
        .groupBy(*KEYS)
        .agg(
            F.max("_k").cast("double").alias("source_count"),
            (
                -F.sum(p * F.log(p + 1e-12))
                / F.when(F.max("_k") > 1, F.log(F.max("_k"))).otherwise(1.0)
            ).alias("source_entropy"),
        )
    )


def sector_scores(aligned: DataFrame, sectors: dict, hour: int = 15, minute: int = 0) -> DataFrame:
    """Decayed sector impact: one column per listed sector, totals over all sectors."""
    per = (
        _scored(aligned, hour, minute)
        .select(*KEYS, "_s", "_i", "_w", F.explode("affected_sectors").alias("_sec", "_sw"))
        .groupBy(*KEYS, "_sec")
        .agg(F.sum(safe_float(F.col("_sw")) * F.col("_s") * F.col("_i") * F.col("_w")).alias("_v"))
    )
    wide = [
        F.sum(F.when(F.col("_sec") == name, F.col("_v")).otherwise(0.0)).alias(f"sector_{slug}")
        for name, slug in sectors.items()
    ]
    return per.groupBy(*KEYS).agg(
        *wide,
        F.sum("_v").alias("news_impact_total"),
        F.sum(F.abs("_v")).alias("news_impact_abs_total"),
    )


def event_counts(aligned: DataFrame, events: dict) -> DataFrame:
    """Items naming each event."""
    return aligned.groupBy(*KEYS).agg(*_event_aggs(events))


def event_shock_flag(daily: DataFrame, min_count=8, min_sent=0.45, min_abs=1.2) -> DataFrame:
    shock = (
        (F.col("news_count") >= min_count)
        | (F.abs("weighted_sentiment") >= min_sent)
        | (F.col("news_impact_abs_total") >= min_abs)
    )
    return daily.withColumn("event_shock_flag", shock.cast("double"))


def news_ewm(daily: DataFrame) -> DataFrame:
    return dense_ewm(
        daily.withColumn("_cnt", F.col("news_count").cast("double")),
        {
            "weighted_sentiment": [("sentiment_ewm_3d", 3), ("sentiment_ewm_5d", 5)],
            "avg_importance": [("importance_ewm_3d", 3), ("importance_ewm_5d", 5)],
            "_cnt": [("news_count_ewm_5d", 5)],
            "news_impact_total": [("impact_ewm_5d", 5)],
        },
    ).drop("_cnt")


def daily_stats(aligned: DataFrame, sectors: dict, events: dict, hour: int = 15, minute: int = 0) -> DataFrame:
    """Base, source, sector and event statistics per (stock_code, trade_date) from one pass over the items.

    An item becomes one row for itself, one for its source and one per sector; all of them are summed by
    (stock, day, facet), map-side first, and what is left, a row per source and sector of a day, is brought together
    by day. Items are aligned and read once whatever the number of facets.
    """
    s, i, w = F.col("_s"), F.col("_i"), F.col("_w")
    name = F.trim(F.coalesce("source", F.lit("")))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    facet = lambda kind, label, v: F.struct(F.lit(kind).alias("kind"), label.alias("name"), v.alias("v"))
    zero = F.lit(0.0)
    weighed = F.transform(F.map_entries("affected_sectors"), lambda e: facet(2, e["key"].cast("string"), safe_float(e["value"]) * s * i * w))
    own = F.array(facet(0, F.lit(""), zero))
    named = F.when(name != "", F.array(facet(1, name, zero))).otherwise(F.slice(own, 1, 0))
    facets = F.concat(own, named, F.coalesce(weighed, F.slice(own, 1, 0)))
    flags = {f"_e_{n}": text.contains(term).cast("int") for term, n in events.items()}
    rows = _scored(aligned, hour, minute).select(*KEYS, "_s", "_i", "_w", *[e.alias(n) for n, e in flags.items()], F.explode(facets).alias("f"))
    itself = lambda v: F.sum(F.when(F.col("f.kind") == 0, v))
    parts = {
        "_n": F.count("*"),
        "_v": F.sum("f.v"),
        "_ss": itself(s),
        "_sw": itself(s * w),
        "_ws": itself(w),
        "_is": itself(i),
        "_im": F.max(F.when(F.col("f.kind") == 0, i)),
        "_up": itself((s > 0.2).cast("int")),
        "_down": itself((s < -0.2).cast("int")),
        "_abs": itself(F.abs(s)),
        **{n: itself(F.col(n)) for n in flags},
    }
    by_facet = rows.groupBy(*KEYS, F.col("f.kind").alias("kind"), F.col("f.name").alias("name")).agg(*[v.alias(n) for n, v in parts.items()])
    kind, n = F.col("kind"), F.col("_n")
    share = n / F.sum("_n").over(Window.partitionBy(*KEYS, "kind"))
    by_facet = by_facet.withColumn("_p", F.when(kind == 1, share * F.log(share + 1e-12)))
    base = lambda c: F.sum(F.when(kind == 0, F.col(c)))
    count, sources = base("_n"), F.count_if(kind == 1)
    return by_facet.groupBy(*KEYS).agg(
        count.alias("news_count"),
        (base("_ss") / count).alias("avg_sentiment"),
        F.when(base("_ws") > 1e-8, base("_sw") / base("_ws")).otherwise(base("_ss") / count).alias("weighted_sentiment"),
        (base("_is") / count).alias("avg_importance"),
        F.max("_im").alias("max_importance"),
        (base("_up") / count).alias("positive_ratio"),
        (base("_down") / count).alias("negative_ratio"),
        base("_abs").alias("news_sentiment_abs_sum"),
        *[base(f"_e_{e}").cast("double").alias(f"event_{e}_count") for e in events.values()],
        sources.cast("double").alias("source_count"),
        (-F.sum("_p") / F.when(sources > 1, F.log(sources)).otherwise(1.0)).alias("source_entropy"),
        *[F.sum(F.when((kind == 2) & (F.col("name") == k), F.col("_v")).otherwise(0.0)).alias(f"sector_{slug}") for k, slug in sectors.items()],
        F.sum(F.when(kind == 2, F.col("_v"))).alias("news_impact_total"),
        F.sum(F.when(kind == 2, F.abs("_v"))).alias("news_impact_abs_total"),
    )


def news_daily_features(aligned: DataFrame, calendar: DataFrame, sectors: dict = defaults.SECTOR_SLUGS, events: dict = defaults.EVENT_SLUGS, hour: int = 15, minute: int = 0) -> DataFrame:
    """All daily news features, one row per calendar day."""
    return news_ewm(event_shock_flag(_on_calendar(calendar, daily_stats(aligned, sectors, events, hour, minute))))


def static_daily(calendar: DataFrame, company: DataFrame, relevance: DataFrame, sectors: dict = defaults.STATIC_SECTOR_SLUGS) -> DataFrame:
    """Per-day static features: concepts, age since listing, relevance summary, sector flags."""
    text = F.concat_ws(" ", F.trim(F.coalesce("sector", F.lit(""))), F.trim(F.coalesce("industry", F.lit(""))))
    dims = company.select(
        "stock_code",
        F.size(F.coalesce("concepts", F.array().cast("array<string>"))).cast("double").alias("static_concept_count"),
        "listing_date",
        *[text.contains(name).cast("double").alias(f"stock_sector_{slug}") for name, slug in sectors.items()],
    )
    zeros = ["relevance_mean", "relevance_max", "relevance_std", "relevance_strong_ratio", "static_concept_count"]
    flags = [f"stock_sector_{slug}" for slug in sectors.values()]
    days = F.datediff("trade_date", "listing_date").cast("double")
    return (
        calendar.select(*KEYS)
        .join(dims, "stock_code", "left")
        .join(relevance, "stock_code", "left")
        .withColumn("static_listing_days", days)
        .fillna(0.0, subset=zeros + flags)
        .drop("listing_date")
    )
