"""A scan task's share of the tables."""

from tickerloom.plans import registry

KEYS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


def test_scan_tasks_stay_small_on_large_tables(spark, tmp_path):
    """A table of 160 MB of row groups of 1 MB is read by tasks of 8 MB, whatever the cores."""
    keep = {k: spark.conf.get(k, None) for k in KEYS}
    try:
        with open(tmp_path / "lines.csv", "wb") as f:
            f.truncate(160 << 20)
        registry.deal_by_size(spark, str(tmp_path))
        tasks = spark.read.text(str(tmp_path / "lines.csv")).rdd.getNumPartitions()
        assert tasks == (160 << 20) // registry.PART
        # a folder of many small files does not make a task of every other file
        small = tmp_path / "small"
        small.mkdir()
        for i in range(200):
            (small / f"{i}.csv").write_text("1\n" * 5000)
        assert spark.read.text(str(small)).rdd.getNumPartitions() <= 8
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
