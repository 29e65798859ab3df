"""News records: parsing, sorting, reading and statistics."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions import codes, defaults, text as tx
from tickerloom.functions.maths import round_half_up, safe_float
from tickerloom.functions.timing import clamp_age_hours, parse_timestamp
from tickerloom.operators.dedupe import multi_key_dedupe
from tickerloom.operators.matching import match_news_to_stocks


def parse_news_rows(raw: DataFrame, category_terms=None, sector_terms=None, title_terms=None, content_chars: int | None = None, **lexicon) -> DataFrame:
    """Raw (title, content, publish_time, source, url) -> scored news records.

    Titles and times are required. Scores read the whole text; ``content_chars`` only cuts the
    stored copy (None keeps it whole).
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    df = raw.withColumns(
        {
            "title": clean("title"),
            "content": clean("content"),
            "publish_time": parse_timestamp(F.col("publish_time")),
            "url": codes.normalize_url(F.col("url")),
            "source": F.coalesce(F.nullif(clean("source"), F.lit("")), F.lit("未知")),
        }
    ).filter((F.col("title") != "") & F.col("publish_time").isNotNull())
    title, content = F.col("title"), F.col("content")
    merged = tx.merged_text(title, content)
    return df.withColumns(
        {
            "news_id": codes.news_id(title, F.col("publish_time"), F.col("url")),
            "categories": tx.classify_categories(merged, category_terms or defaults.CATEGORY_TERMS),
            "sentiment": tx.hybrid_sentiment(merged, title, **lexicon),
            "importance": tx.importance(title, content, title_terms or defaults.IMPORTANT_TITLE_WORDS),
            "affected_sectors": tx.affected_sectors(merged, sector_terms or defaults.SECTOR_TERMS),
            "content": content if content_chars is None else F.substring(content, 1, content_chars),
        }
    )


def build_news_raw(news: DataFrame) -> DataFrame:
    """Persisted form: times as text, nested fields as JSON text."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return news.select(
        "stock_code",
        s("news_id").alias("news_id"),
        F.coalesce(F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("publish_time"),
        s("source").alias("source"),
        s("title").alias("title"),
        s("content").alias("content"),
        s("url").alias("url"),
        F.coalesce(F.to_json("categories"), F.lit("[]")).alias("categories"),
        safe_float(F.col("sentiment")).alias("sentiment"),
        safe_float(F.col("importance")).alias("importance"),
        F.coalesce(F.to_json("affected_sectors"), F.lit("{}")).alias("affected_sectors"),
    )


def sort_news(news: DataFrame) -> DataFrame:
    """Newest first; items without a time count as 1970."""
    ts = F.coalesce("publish_time", F.lit("1970-01-01").cast("timestamp"))
    return news.orderBy(ts.desc(), "news_id")


def news_with_fallback(stock_news: DataFrame, global_news: DataFrame, alias_dim: DataFrame, limit: int | None = None) -> DataFrame:
    """Own news of a stock where there is any, otherwise the global items that name it."""
    have = stock_news.select("stock_code").distinct()
    missing = alias_dim.join(have, alias_dim["code"] == have["stock_code"], "left_anti")
    matched = match_news_to_stocks(global_news, missing, limit)
    return stock_news.unionByName(matched.select(*[c for c in stock_news.columns if c in matched.columns]), allowMissingColumns=True)


def news_query(news: DataFrame, alias_dim: DataFrame, stock: str | None = None, source: str | None = None, limit: int = 50, as_of: Column | None = None, max_age_hours=72):
    """Source filter, stock filter, de-duplication, freshness and limit.

    Returns the page and a one-row table of counters, both lazy up to the de-duplication.
    """
    df = news if source in (None, "all") else news.filter(F.col("source") == source)
    timed = df.filter(F.col("publish_time").isNotNull())
    picked = timed
    if stock is not None:
        names = alias_dim.filter(F.col("code") == stock)
        picked = match_news_to_stocks(timed, names).drop("stock_code")
    unique = multi_key_dedupe(picked)
    hours = clamp_age_hours(max_age_hours)
    fresh = unique
    if hours is not None and as_of is not None:
        fresh = unique.filter(F.col("publish_time") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    n = lambda d: d.agg(F.count("*")).scalar()
    counters = (
        df.agg(
            F.count_if(F.col("publish_time").isNull()).alias("bad_timestamp_count"),
            F.count("publish_time").alias("_timed"),
        )
        .withColumns({"_picked": n(picked), "_unique": n(unique), "_fresh": n(fresh)})
        .select(
            "bad_timestamp_count",
            (F.col("_timed") - F.col("_picked")).alias("stock_filtered_out_count"),
            (F.col("_picked") - F.col("_unique")).alias("dedup_removed_count"),
            (F.col("_unique") - F.col("_fresh")).alias("age_filtered_count"),
        )
    )
    return sort_news(fresh).limit(max(1, limit)), counters


def sync_merge(news: DataFrame):
    """De-duplicated union of all sources and (source, fetched) plus totals."""
    unique = multi_key_dedupe(news)
    per = news.groupBy("source").agg(F.count("*").alias("fetched"))
    kept = unique.agg(F.count("*")).scalar()
    totals = news.agg(F.count("*").alias("raw_total")).withColumn("unique_total", kept)
    return unique, per, totals.withColumn("removed", F.col("raw_total") - F.col("unique_total"))


def news_statistics(news: DataFrame) -> DataFrame:
    """One row: counts by polarity and mean scores."""
    s = safe_float(F.col("sentiment"))
    out = news.agg(
        F.count("*").alias("total"),
        F.count_if(s > 0.2).alias("positive"),
        F.count_if(s < -0.2).alias("negative"),
        round_half_up(F.avg(s), 3).alias("avg_sentiment"),
        round_half_up(F.avg(safe_float(F.col("importance"))), 2).alias("avg_importance"),
    )
    return out.withColumn("neutral", F.col("total") - F.col("positive") - F.col("negative"))


def news_distributions(news: DataFrame, top: int = 10) -> DataFrame:
    """(kind, name, n): items per source, and per sector for the ten most frequent sectors."""
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown"))
    by_source = news.groupBy(source.alias("name")).agg(F.count("*").alias("n")).select(F.lit("source").alias("kind"), "name", "n")
    by_sector = (
        news.select(F.explode(F.map_keys("affected_sectors")).alias("name"))
        .groupBy("name")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "name")
        .limit(top)
        .select(F.lit("sector").alias("kind"), "name", "n")
    )
    return by_source.unionByName(by_sector)


def recent_periods(reports: DataFrame, n: int = 4, key: str = "stock_code", period: str = "period") -> DataFrame:
    """Last n reporting periods per company; one map of item -> value per period."""
    w = Window.partitionBy(key).orderBy(F.col(period).desc())
    periods = (
        reports.select(key, period).distinct().withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    )
    return (
        reports.join(periods, [key, period])
        .groupBy(key, period)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("item", "value")))).alias("ratios"))
    )


# Fields of an announcement and of a research report.
ANNOUNCEMENT_FIELDS = ["title", "type", "date", "url"]
REPORT_FIELDS = ["title", "institution", "rating", "date", "author"]


def _first_entries(entries: DataFrame, fields: list[str], limit: int, key: str, order: str) -> DataFrame:
    """The first ``limit`` entries of each company in their source's order, fields as texts, missing ones empty; cut
    per task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), *fields)
    text = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in entries.columns else F.lit("").alias(f) for f in fields]
    rows = entries.select(key, order, *text).withColumn("place", F.row_number().over(w))
    return rows.filter(F.col("place") <= limit).select(key, "place", *fields)


def company_announcements(entries: DataFrame, limit: int = 20, key: str = "stock_code", order: str = "seq") -> DataFrame:
    """(stock_code, place, title, type, date, url): each company's first announcements as listed."""
    return _first_entries(entries, ANNOUNCEMENT_FIELDS, limit, key, order)


def research_reports(entries: DataFrame, limit: int = 10, key: str = "stock_code", order: str = "seq") -> DataFrame:
    """(stock_code, place, title, institution, rating, date, author): each company's first research reports as listed."""
    return _first_entries(entries, REPORT_FIELDS, limit, key, order)
