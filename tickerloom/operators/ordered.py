"""Running aggregates over long ordered groups without a single-task window.

Rows are range-partitioned on the ordering columns and a unique key, sorted there, numbered and written once. Between
partitions only one small row per (group, partition) is carried. A group that holds most of the data, or a value that
all rows share, is thus spread over many tasks; the number of partitions is that of the session's shuffles, which
adaptive execution brings down for few rows.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir, else one below the warehouse, which executors share too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tickerloom-scratch"
    sc.setCheckpointDir(folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tickerloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors and
    lets later passes read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_bucket(df: DataFrame, order: str, by=(), bits: int = 8, cuts_from: DataFrame | None = None) -> DataFrame:
    """+_bucket in [0, 2**bits), non-decreasing in ``order`` (numeric) within each group.

    ``cuts_from`` is a cheaper table with the same ordering column to take the quantiles from.
    """
    n = 2**bits
    cuts = F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], 100 * n)
    if by:
        limits = df.groupBy(*by).agg(cuts.alias("_cuts"))
        for k in by:
            limits = limits.withColumnRenamed(k, f"_g_{k}")
        cond = F.lit(True)
        for k in by:
            cond = cond & df[k].eqNullSafe(limits[f"_g_{k}"])
        cut = df.join(limits, cond, "left").drop(*[f"_g_{k}" for k in by])
    else:
        cut = df.withColumn("_cuts", (df if cuts_from is None else cuts_from).agg(cuts).scalar())
    steps = F.array(*[F.lit(2**i) for i in reversed(range(bits))])
    value = F.col(order).cast("double")
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda lo, s: F.when(F.element_at("_cuts", lo + s) < value, lo + s).otherwise(lo),
    )
    return cut.withColumn("_bucket", F.coalesce(place, F.lit(0))).drop("_cuts")


PLACE_BITS = 33  # of a generated id: the row's place in its partition; the bits above name the partition


def ranged(df: DataFrame, keys, name: str, bits: int | None = None) -> DataFrame:
    """+_part, +_at: rows in the order of ``keys`` as (partition, place within it), written once and read back.

    ``bits`` asks for 2**bits partitions in place of the session's number. The range limits come from a pass of their own
    over the rows, so these are written first: what makes them runs once.
    """
    rows = materialize(df, f"{name}-rows").repartitionByRange(*([] if bits is None else [2**bits]), *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    part, at = F.shiftrightunsigned("_id", PLACE_BITS), F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return materialize(rows.withColumns({"_part": part, "_at": at}).drop("_id"), name)


def running_total(df: DataFrame, order: str, cols, by=(), bits: int | None = None) -> DataFrame:
    """+cum_<col>, +all_<col>: running sum in ascending ``order`` (unique per group) and group total."""
    by, cols = list(by), list(cols)
    parts = ranged(df, [*by, order], "running", bits)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        parts.groupBy(*by, "_part")
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
        .select(
            *[F.col(k).alias(f"_g_{k}") for k in by],
            F.col("_part").alias("_cp"),
            *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols],
            *[F.sum(f"_t_{c}").over(Window.partitionBy(*by)).alias(f"all_{c}") for c in cols],
        )
    )
    cond = F.col("_part") == F.col("_cp")
    for k in by:
        cond = cond & parts[k].eqNullSafe(F.col(f"_g_{k}"))
    here = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = parts.join(carry, cond)
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.sum(c).over(here)).alias(f"cum_{c}") for c in cols],
        *[f"all_{c}" for c in cols],
    )


def global_rank(df: DataFrame, score: str, tie: str, name: str = "rank", bits: int | None = None) -> DataFrame:
    """+rank from 1 by descending score, then ``tie``: places inside partitions plus the rows of the partitions before.

    One range shuffle on (score, tie), so equal scores are spread like any others; NULL scores rank last.
    """
    parts = ranged(df, [F.col(score).desc_nulls_last(), F.col(tie).asc()], "ranked", bits)
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(
        F.col("_part").alias("_cp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    return parts.join(offsets, F.col("_part") == F.col("_cp")).select(*df.columns, (F.col("_off") + F.col("_at") + 1).alias(name))


NEAR = (0.494, 0.506)  # quantiles that enclose the median; approximate ones are off by a thousandth of the rows at most


def exact_median(df: DataFrame, cols, written: bool = False) -> DataFrame:
    """(col, median) of each column, NULLs and NaN ignored, middle values averaged.

    Approximate quantiles on both sides of the middle enclose the median; the values below are only counted, and the
    running count goes over the distinct values between. Were an enclosure to miss the middle, its column is taken whole.
    The rows are read three times and so written first, unless they are ``written`` already.
    """
    cols = list(cols)
    value = {c: F.col(c).cast("double") for c in cols}
    values = df.select(*[F.when(~F.isnan(v), v).alias(f"_{i}") for i, v in enumerate(value.values())])
    values = values if written else materialize(values, "values")
    near = values.agg(*[F.percentile_approx(f"_{i}", list(NEAR), 1000).alias(f"_{i}") for i in range(len(cols))]).first()
    bounds = {i: near[i] for i in range(len(cols)) if near[i] is not None}
    if not bounds:
        return df.sparkSession.createDataFrame([], "col string, median double")
    below = {i: F.count_if(F.col(f"_{i}") < lo).alias(f"b{i}") for i, (lo, _) in bounds.items()}
    upto = {i: F.count_if(F.col(f"_{i}") <= hi).alias(f"u{i}") for i, (_, hi) in bounds.items()}
    seen = values.agg(*below.values(), *upto.values(), *[F.count(f"_{i}").alias(f"n{i}") for i in bounds]).first()
    parts = []
    for i, (lo, hi) in bounds.items():
        n, low, here = seen[f"n{i}"], seen[f"b{i}"], F.col(f"_{i}").between(lo, hi)
        if low >= (n + 1) // 2 or seen[f"u{i}"] < n // 2 + 1:
            low, here = 0, F.col(f"_{i}").isNotNull()
        parts.append(F.when(here, F.struct(F.lit(cols[i]).alias("col"), F.col(f"_{i}").alias("v"), F.lit(low).alias("low"), F.lit(n).alias("all"))))
    inside = values.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*")
    ranked = running_total(inside.groupBy("col", "low", "all", "v").agg(F.count("*").alias("n")), "v", ["n"], by=["col"])
    upper = F.col("low") + F.col("cum_n")
    has = lambda r: (upper - F.col("n") < r) & (r <= upper)
    lo, hi = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    return (
        ranked.groupBy("col")
        .agg(((F.max(F.when(has(lo), F.col("v"))) + F.max(F.when(has(hi), F.col("v")))) / 2).alias("median"))
    )
