"""De-duplication of records and news items."""

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.functions.codes import normalize_url
from tickerloom.functions.text import news_quality_score, normalize_text, strip_html
from tickerloom.functions.timing import bucket_30m
from tickerloom.operators.ordered import ensure_checkpoint_dir, materialize, with_bucket


def dedupe_by_date(df: DataFrame, key: str = "stock_code", day: str = "trade_date", order=()) -> DataFrame:
    """First row per (key, day); ``order`` makes the choice repeatable.

    A min over the ordering replaces a window, so copies collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, day)]
    first = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in (order or rest)]))
    return df.groupBy(key, day).agg(first.alias("_r")).select(key, day, "_r.*").select(*df.columns)


def exact_record_dedupe(raw: DataFrame, arrival: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """First record per (clean title, time, link); blank titles go. Returns kept rows and counts."""
    key = [
        strip_html(F.col("title")).alias("_t"),
        F.trim(F.coalesce(F.col("publish_time").cast("string"), F.lit(""))).alias("_p"),
        F.trim(F.coalesce(F.col("url"), F.lit(""))).alias("_u"),
    ]
    rest = [c for c in raw.columns if c != arrival]
    kept = (
        raw.filter(strip_html(F.col("title")) != "")
        .groupBy(*key)
        .agg(F.min(arrival).alias(arrival), F.min_by(F.struct(*rest), arrival).alias("_r"))
        .select(arrival, "_r.*")
        .select(*raw.columns)
    )
    counts = raw.agg(
        F.count("*").alias("raw"),
        F.count_distinct(F.when(strip_html(F.col("title")) != "", F.struct(*key))).alias("kept"),
    ).withColumn("removed", F.col("raw") - F.col("kept"))
    return kept, counts


def news_keys(news: DataFrame, arrival: str) -> DataFrame:
    """(arrival, prio, key): identity keys of each item, strongest first."""
    nid = F.trim(F.coalesce("news_id", F.lit("")))
    title = normalize_text(F.col("title"))
    url = normalize_url(F.col("url"))
    half = bucket_30m(F.col("publish_time"))
    titled = title != ""
    timed = F.col("publish_time").isNotNull()
    key = lambda prio, cond, *parts: F.when(
        cond, F.struct(F.lit(prio).alias("prio"), F.concat_ws("::", *parts).alias("key"))
    )
    keys = F.array(
        key(1, nid != "", F.lit("id"), nid),
        key(2, titled & timed, F.lit("title_bucket"), title, F.date_format(half, "yyyyMMddHHmm")),
        key(3, titled & timed, F.lit("title_day"), title, F.date_format(half, "yyyyMMdd")),
        key(2, titled & ~timed, F.lit("title"), title),
        key(4, titled & (url != ""), F.lit("url"), url),
    )
    return news.select(F.col(arrival).alias("arr"), F.explode(F.array_compact(keys)).alias("k")).select("arr", "k.*")


def _leaders(keys: DataFrame, bits: int) -> DataFrame:
    """(arr, parent): the item whose slot each item joins, itself when it opens a slot.

    An item is decided by its strongest key that an earlier item has too, and joins the slot of
    the latest earlier item with that key. Along one key, items decided by that same key simply
    pass the slot on, so the parent is the latest earlier item *not* decided by it.
    """
    seen = keys.groupBy("key").agg(F.min("arr").alias("_first")).filter(F.col("_first").isNotNull())
    known = keys.join(seen, "key").withColumn("_known", F.col("arr") > F.col("_first"))
    per_item = Window.partitionBy("arr")
    decided = known.withColumn("_dec", F.min(F.when(F.col("_known"), F.col("prio"))).over(per_item))
    decided = decided.withColumn("_by_key", F.col("prio") == F.coalesce("_dec", F.lit(0)))
    decided = materialize(decided.select("arr", "key", "_dec", "_by_key"), "keys")
    opener = decided.withColumn("_o", F.when(~F.col("_by_key"), F.col("arr")))
    # the latest opener before each row, carried across arrival buckets so hot keys are split
    parts = with_bucket(opener, "arr", bits=bits, cuts_from=decided.select("arr"))
    before = Window.partitionBy("key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.groupBy("key", "_bucket").agg(F.max("_o").alias("_m")).select(
        "key", "_bucket", F.max("_m").over(before).alias("_carry")
    )
    here = Window.partitionBy("key", "_bucket").orderBy("arr").rowsBetween(Window.unboundedPreceding, -1)
    parents = (
        parts.withColumn("_near", F.max("_o").over(here))
        .filter("_by_key")
        .join(carry, ["key", "_bucket"])
        .select("arr", F.coalesce("_near", "_carry").alias("parent"))
    )
    roots = decided.filter(F.col("_dec").isNull()).select("arr", F.col("arr").alias("parent")).distinct()
    return parents.unionByName(roots)


def _resolve(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(arr, slot): follow parents to the opening item by pointer jumping.

    Only items that are somebody's parent take part in the rounds; the number of rounds is the
    logarithm of the longest chain of key changes.
    """
    ensure_checkpoint_dir(parents.sparkSession)
    parents = parents.checkpoint()
    hubs = parents.select(F.col("parent").alias("arr")).distinct()
    links = parents.join(hubs, "arr", "left_semi")
    for _ in range(max_rounds):
        up = links.select(F.col("arr").alias("parent"), F.col("parent").alias("_up"))
        links = (
            links.join(up, "parent").select("arr", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("_moved"))
        ).checkpoint()
        if links.filter("_moved").isEmpty():
            break
    else:
        raise RuntimeError("slots did not settle")
    top = links.select(F.col("arr").alias("parent"), F.col("parent").alias("slot"))
    return parents.join(top, "parent").select("arr", "slot")


def news_slots(news: DataFrame, arrival: str = "arrival", bits: int = 8) -> DataFrame:
    """(arr, slot) of every item that has a key; slot is the arrival number that opened it."""
    return _resolve(_leaders(news_keys(news, arrival), bits))


def multi_key_dedupe(news: DataFrame, arrival: str = "arrival", bits: int = 8) -> DataFrame:
    """One item per slot: the best quality, the earliest among equals; newest first.

    Equals visiting the items one by one in order of ``arrival`` (a unique number), pointing
    every key of an item at the slot it joined. Items without any key are dropped.
    """
    quality = news.select(
        F.col(arrival).alias("arr"),
        news_quality_score(F.col("content"), F.col("importance"), F.col("url")).alias("_q"),
    )
    best = (
        quality.join(news_slots(news, arrival, bits), "arr")
        .groupBy("slot")
        .agg(F.max_by("arr", F.struct(F.col("_q"), -F.col("arr"))).alias(arrival))
        .select(arrival)
    )
    kept = news.join(best, arrival, "left_semi")
    return kept.orderBy(F.coalesce("publish_time", F.lit("1970-01-01").cast("timestamp")).desc(), arrival)
