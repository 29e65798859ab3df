"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Targets: sources share a budget by weight; a target stops at a multiple of its source's size and the
excess is shared anew by weight. The fixed point is min(level * weight, cap * size) with one common
level, found from running sums over the sources ordered by cap * size / weight.

Selection: each document has a 60-bit hash of its id. A source takes all of its documents once for
every whole multiple of its size in its target, and for the rest those whose hash lies below a
threshold: the largest one whose documents together stay within the remaining budget. The threshold
comes from nested histograms, 12 bits a level: sum sizes by source and bucket, find the bucket in
which the running sum crosses the budget, and refine only that bucket. No rows are sorted, nothing
is gathered, and equal hashes (repeated ids) are taken together or not at all.

Defined cases: null or empty texts have size 0; a null source is the last source; a null id is
hashed as empty text; a source of size 0 has target 0; a single source larger than half of its
target is taken more than once, never more than ``cap`` times; reruns agree, since hashes depend on ids alone.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.llm.common import stored

WEIGHTS = (3, 1, 2)
LEVELS, BITS = 5, 12


def size_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``: ends of words, one pass over the text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, copies, budget, taken_all): one row per source.

    The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.partitionBy().orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    every = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(from_here))
    free = F.col("level") * F.col("weight") <= F.col("most")
    level = F.max(F.when(free, F.col("level"))).over(every)  # the first source that stays below its cap; levels fall after it
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least(level * F.col("weight"), F.col("most")))
    per = per.withColumn("target", target)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return per.withColumn("copies", copies).select(
        "source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget")
    )


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets + threshold: hashes below it are taken. One small table per level, none of them sorted."""
    spark = sizes.sparkSession
    state = targets.withColumns({"prefix": F.lit(0).cast("long"), "rest": F.col("budget"), "open": F.lit(True)})
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        at = state.filter("open").select(F.col("source").alias("_s"), F.col("prefix").alias("_p"), F.col("rest").alias("_r"))
        inside = sizes.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift + BITS) == F.col("_p")), "inner") if level else sizes
        counts = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        at = state.filter("open").select(F.col("source").alias("_s"), F.col("rest").alias("_r"))
        crossed = (
            counts.withColumn("run", run)
            .join(at, F.col("source").eqNullSafe(F.col("_s")))
            .filter(F.col("run") > F.col("_r"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", F.col("run"), F.col("n"))).alias("b"))
            .select(F.col("source").alias("_s"), F.col("b.bucket").alias("_b"), (F.col("b.run") - F.col("b.n")).alias("_below"))
        )
        joined = state.join(crossed, F.col("source").eqNullSafe(F.col("_s")), "left")
        # no bucket crosses: all of what is left fits, so the threshold is the end of the present prefix
        end = (F.col("prefix") + 1) * F.lit(2**BITS if level else 1)
        whole = F.lit(2**BITS).cast("long") if level == 0 else end
        prefix = F.when(~F.col("open"), F.col("prefix") * F.lit(2**BITS)).when(F.col("_b").isNull(), whole).otherwise(F.col("_b"))
        state = joined.select(
            "source", "source_size", "target", "copies", "budget",
            prefix.cast("long").alias("prefix"),
            F.when(F.col("open") & F.col("_b").isNotNull(), F.col("rest") - F.col("_below")).otherwise(F.col("rest")).alias("rest"),
            (F.col("open") & F.col("_b").isNotNull()).alias("open"),
        )
        state = stored(state, "mix-level")
    return state.select("source", "source_size", "target", "copies", "budget", F.col("prefix").alias("threshold"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(id, source, size, hash, source_size, target, n_taken, taken) of every document."""
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("hash")), "mix-sizes")
    plan = thresholds(sizes, stored(source_targets(sizes, weights, share, cap), "mix-targets")).withColumnRenamed("source", "_s")
    times = F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    # at the cap the copies already fill the target; the threshold then adds nothing but documents of size 0
    times = F.least(times, F.lit(int(cap))).cast("long")
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "hash", "source_size", "target", times.alias("n_taken"), (times * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Equal ids have equal hashes, so only the
    thresholds, one row per source, are joined to the texts."""
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("hash")), "mix-sizes")
    plan = thresholds(sizes, stored(source_targets(sizes, weights, share, cap), "mix-targets")).select(
        F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies"), F.col("threshold").alias("_mix_threshold")
    )
    times = F.least(F.col("_mix_copies") + F.when(hash60(F.col(id_col)) < F.col("_mix_threshold"), 1).otherwise(0), F.lit(int(cap))).cast("int")
    return (
        docs.join(plan, F.col(source_col).eqNullSafe(F.col("_mix_source")))
        .filter(times >= 1)
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), times)))
        .select(*docs.columns)
    )


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS hash
  FROM documents),
p AS (SELECT source, sum(size)::DOUBLE AS source_size, 2.0 * sum(size) AS most FROM s GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3)::INT] AS weight FROM p),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least((SELECT max(level) FROM l WHERE level * weight <= most) * weight, most) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
d AS (SELECT doc_id, size, c.source_size, target, copies, target - copies * c.source_size AS budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 4) AS target,
       CAST(size * least(copies + CASE WHEN run <= budget THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM d
"""
