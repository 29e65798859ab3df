"""Run a stream to the end of its input and give the result as a table."""

from pyspark.sql import DataFrame, functions as F

from tickerloom.operators.ordered import scratch_path


def run_available(sdf: DataFrame, mode: str = "append", name: str = "stream", keys=(), counts: dict | None = None) -> DataFrame:
    """Process what is available into the shared folder and read it back.

    append goes to the transactional Parquet sink. update writes one folder per micro-batch, so a retried
    batch repeats its output; of updated rows the latest per ``keys`` is kept. A stream without input gives an empty
    table. ``counts``, if given, receives how many state rows were removed and how many rows came too late.
    """
    spark = sdf.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = sdf.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    if counts is not None:
        state = [s for p in query.recentProgress for s in p["stateOperators"]]
        counts.update(removed=sum(s["numRowsRemoved"] for s in state), late=sum(s["numRowsDroppedByWatermark"] for s in state))
    if not progress:
        return spark.createDataFrame([], sdf.schema)
    table = spark.read.parquet(out)
    if mode == "update":
        rest = [c for c in sdf.columns if c not in keys]
        latest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
        return latest.select(*keys, "r.*").select(*sdf.columns)
    return table
