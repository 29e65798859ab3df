"""Many small files per stock: the work is dealt by files, not by bytes, and folders are not listed by a task each."""

import os

from pyspark.sql import functions as F

from tickerloom.sources import market


def test_folders_are_written_by_many_tasks_and_listed_by_few(spark, tmp_path):
    bars = spark.range(600).select(
        F.lpad((F.col("id") % 300).cast("string"), 6, "0").alias("stock_code"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") / 300).cast("int")).alias("trade_date"),
        *[F.lit(1.5).alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    path, sc, kept = str(tmp_path / "bars"), spark.sparkContext, spark.conf.get(market.LISTING)
    market.write_market_dir(bars, path)
    parts = {name.split("-")[1] for d, _, names in os.walk(path) for name in names if name.startswith("part-")}
    assert len(parts) > sc.defaultParallelism  # the bytes would fit one task
    sc.setJobGroup("listing", "folders of bars")
    try:
        rows = market.scan_market_dir(spark, path, folders=True)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= market.WAVES * sc.defaultParallelism
    assert spark.conf.get(market.LISTING) == kept
    assert rows.groupBy("stock_code").count().filter("count = 2").count() == 300
