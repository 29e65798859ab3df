"""Registry of named queries and their SQL counterparts."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict = {}
ORACLES: dict = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


PART, MERGED = 8 << 20, "8m"  # bytes of input per shuffle partition and scan task; shuffled bytes up to which adaptive execution joins them
OPEN_COST = 128 << 10  # bytes that a file counts for beside its own in a scan task, so that folders of small files are read by the hundred

COMPILED = 8000  # bytes of a generated method above which the JVM only interprets it; Spark then splits the stage's expressions into short ones


def deal_by_size(spark: SparkSession, sf_dir: str) -> None:
    """Shuffle partitions and scan tasks in step with the input, never fewer than the session has: with a fixed number, or splits
    that grow up to 128 MB, a task's rows, and the memory of its sorts, grow with the tables. Without a folder nothing is changed."""
    if not sf_dir:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = -(-size // PART)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED)
        spark.conf.set("spark.sql.files.maxPartitionBytes", PART)
        spark.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)


def query(name: str, sql: str | None = None, d: str = "", i: str = "", t: str = ""):
    """Register a query. ``d``, ``i``, ``t`` name the double, integer and date columns of the SQL."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
            deal_by_size(spark, sf_dir)
            return tidy(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, d.split(), i.split(), t.split())
        return fn

    return register


def oracle(sql: str, doubles=(), ints=(), dates=()) -> str:
    """Prepend the CTEs a statement needs and bring its columns to comparable types."""
    casts = [f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in doubles]
    casts += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    casts += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
    body = f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{sql}\n) q" if casts else sql
    used: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                used.append(name)

    visit(sql)
    if not used:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in used) + "\n" + body


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: dates as text, integers as long, doubles rounded to six places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c.cast("double")
            # a zero stays one; rounding goes by decimals and texts, and sparse columns are mostly zeros
            c = F.when(c == 0, F.lit(0.0)).otherwise(F.round(c + F.lit(1e-9), 6) + F.lit(0.0))
        cols.append(c.alias(f.name))
    return df.select(*cols)
