"""What the operators of this subpackage share: tables, scratch tables, batches, words."""

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_ROWS, BATCH_BYTES = 5000, "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at so many rows or bytes: a Python worker's memory follows neither table nor text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``, else the warehouse)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, distinct: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared folder and read back: short lineage, and a lost executor costs no recomputation.
    No dictionaries are tried for the columns whose values hardly repeat."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**{f"parquet.enable.dictionary#{c}": "false" for c in distinct}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, schema: str, fn: Callable[[list[list]], Iterator[tuple] | list[tuple]]) -> DataFrame:
    """``fn`` gets the columns of a batch as lists and returns rows of ``schema``; one batch in memory at a time."""
    names, types = _fields(df.sparkSession, schema)

    def run(batches):
        for b in batches:
            rows = list(fn([c.to_pylist() for c in b.columns]))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return df.mapInArrow(run, schema)


def _fields(spark: SparkSession, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return arrow.names, list(arrow.types)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered: bytes.lower and bytes.split touch ASCII only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def held_out(col: str, k: int):
    """Whether crc32(id as text) mod k is 1; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(k)) == 1


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): connected components of edges (a, b) between longs; equal labels, equal component.

    Each round gives every node the least id among itself and its neighbours and contracts the edges
    to labels; the ids should be hashes, so that a round removes a constant share of the nodes in
    expectation, chains included. Only counts reach the driver. Nodes without an edge are left out.
    """
    steps = []
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), f"{name}-edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-labels")
        steps.append(label)
        la = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = stored(
            edges.join(la, "a").join(lb, "b").filter(F.col("la") != F.col("lb")).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(),
            f"{name}-edges",
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = steps[0]
    for s in steps[1:]:
        nxt = s.select(F.col("node").alias("label"), F.col("label").alias("_n"))
        out = out.join(nxt, "label", "left").select("node", F.coalesce("_n", "label").alias("label"))
    return out
