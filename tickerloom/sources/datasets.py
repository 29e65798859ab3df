"""Named datasets: Parquet first, CSV as fallback."""

from pyspark.sql import DataFrame, SparkSession


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_dataset(spark: SparkSession, base: str, name: str, schema=None) -> DataFrame:
    """base/name.parquet if present, else base/name.csv."""
    if _exists(spark, f"{base}/{name}.parquet"):
        return spark.read.parquet(f"{base}/{name}.parquet")
    if _exists(spark, f"{base}/{name}.csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(f"{base}/{name}.csv")
    raise FileNotFoundError(f"no dataset {name} under {base}")


def write_dataset(df: DataFrame, base: str, name: str, partition_by=(), mode: str = "overwrite") -> str:
    """Write base/name.parquet, optionally partitioned; returns the path."""
    path = f"{base}/{name}.parquet"
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
