"""Daily bars: per-stock CSV directories, cleaning, coverage checks and inventory."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickerloom.functions.timing import parse_timestamp
from tickerloom.operators.dedupe import dedupe_by_date
from tickerloom.operators.technical import tail_days

CSV_SCHEMA = "date string, open string, high string, low string, close string, volume string"
FILE_CODE = r"^(\d{6})\.csv$"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
WAVES = 4  # tasks per core where the work goes with the number of files


def _file_tasks(spark: SparkSession) -> int:
    return WAVES * spark.sparkContext.defaultParallelism


def write_market_dir(bars: DataFrame, path: str) -> None:
    """Bars as a directory with one folder ``file=<code>.csv`` per stock, written by many tasks at once.

    A file costs the same however few its rows, so the tasks are numbered here and not joined by their bytes.
    """
    spark = bars.sparkSession
    tasks = max(_file_tasks(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = [F.date_format("trade_date", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume"]
    rows = bars.select(F.concat("stock_code", F.lit(".csv")).alias("file"), *cols)
    rows.repartition(tasks, "file").sortWithinPartitions("file", "date").write.partitionBy("file").option("header", True).csv(path)


def _bar_files(spark: SparkSession, path: str, schema: str, folders: bool) -> DataFrame:
    """+stock_code from the name of the file, or of the folder; others are ignored."""
    # folders are listed by some tasks a core, not by a task each
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, _file_tasks(spark))
    try:
        df = spark.read.option("header", True).schema(f"{schema}, file string" if folders else schema).csv(path)
    finally:
        spark.conf.set(LISTING, before)
    code = F.regexp_extract(F.col("file") if folders else F.col("_metadata.file_name"), FILE_CODE, 1)
    named = df.select(*df.drop("file").columns, code.alias("stock_code"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"))
    return named.filter(F.col("stock_code") != "")


def scan_market_dir(spark: SparkSession, path: str, schema: str = CSV_SCHEMA, folders: bool = False) -> DataFrame:
    """All <code>.csv files of a directory as one table, or with ``folders`` all that ``write_market_dir`` wrote; other files are ignored."""
    return _bar_files(spark, path, schema, folders).drop("_path", "_size")


def standardize_ohlcv(df: DataFrame, days: int | None = None) -> DataFrame:
    """Typed, de-duplicated bars with trade_date; optionally the last ``days`` of each stock."""
    missing = [c for c in ("date", "open", "high", "low", "close", "volume") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    numeric = [c for c in ("open", "high", "low", "close", "volume", "change_pct") if c in df.columns]
    out = df.withColumn("trade_date", F.to_date(parse_timestamp(F.col("date")))).filter("trade_date is not null")
    out = out.withColumns({c: F.col(c).try_cast("double") for c in numeric}).select("stock_code", "trade_date", *numeric)
    out = dedupe_by_date(out)
    return out if days is None else tail_days(out, days)


def coverage_gate(df: DataFrame, as_of: Column, days: int, max_age: int = 7) -> DataFrame:
    """Keep stocks whose last bar is recent enough and that have at least half of ``days`` rows."""
    ok = df.groupBy("stock_code").agg(F.max("trade_date").alias("_last"), F.count("*").alias("_n"))
    ok = ok.filter((F.datediff(as_of, "_last") <= max_age) & (F.col("_n") >= 0.5 * days))
    return df.join(ok.select("stock_code"), "stock_code", "left_semi")


def has_recent_data(df: DataFrame, as_of: Column, max_age: int = 1) -> DataFrame:
    """(stock_code, last_date, recent)."""
    last = df.groupBy("stock_code").agg(F.max("trade_date").alias("last_date"))
    return last.withColumn("recent", F.datediff(as_of, "last_date") <= max_age)


def storage_inventory(spark: SparkSession, path: str, schema: str = CSV_SCHEMA, folders: bool = False) -> DataFrame:
    """Rows, latest date and size of the files per stock of a bar directory."""
    rows = _bar_files(spark, path, schema, folders)
    latest = F.max(F.to_date(parse_timestamp(F.col("date"))))
    files = rows.groupBy("stock_code", "_path").agg(F.count("*").alias("n"), latest.alias("day"), F.max("_size").alias("size"))
    return files.groupBy("stock_code").agg(F.sum("n").alias("data_count"), F.max("day").alias("latest_date"), F.sum("size").alias("size"))


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count("*").alias("total_files"), F.sum("size").alias("total_size"))
