"""Ranks and running totals on one range shuffle: tied scores over many tasks, nulls, empty tables."""

from pyspark.sql import functions as F

from tickerloom.operators.ordered import exact_median, global_rank, ranged, running_total


def test_tied_scores_are_spread(spark):
    df = spark.range(20_000).select(F.format_string("%05d", "id").alias("stock_code"), F.lit(0.5).alias("score")).repartition(5)
    parts = ranged(df, [F.col("score").desc_nulls_last(), F.col("stock_code").asc()], "t", bits=4)
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
    got = global_rank(df, "score", "stock_code", bits=4)
    assert got.filter(F.col("rank") != F.col("stock_code").cast("long") + 1).count() == 0 and got.count() == 20_000


def test_ranks_with_nulls_and_ties(spark):
    rows = [("d", None, 1), ("a", 2.0, 1), ("c", 2.0, 1), ("b", 3.0, 1), ("e", None, 1), ("f", -1.0, 1)]
    df = spark.createDataFrame(rows, "stock_code string, score double, _part int")
    got = {r.stock_code: r["rank"] for r in global_rank(df.drop("_part"), "score", "stock_code").collect()}
    assert got == {"b": 1, "a": 2, "c": 3, "f": 4, "d": 5, "e": 6}
    assert global_rank(df.drop("_part").limit(0), "score", "stock_code").count() == 0


def test_running_total_of_many_and_hot_groups(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), F.col("id").alias("o"), F.lit(2).alias("v"))
    df = df.union(spark.createDataFrame([(None, 1, 2), (None, 2, 2)], "g string, o long, v int"))
    rows = df.collect()
    for bits in (None, 0, 4):
        got = {(r.g, r.o): (r.cum_v, r.all_v) for r in running_total(df, "o", ["v"], by=["g"], bits=bits).collect()}
        by = {}
        for r in sorted(rows, key=lambda r: r.o):
            by.setdefault(r.g, []).append(r.o)
        assert got == {(g, o): (2 * (i + 1), 2 * len(os)) for g, os in by.items() for i, o in enumerate(os)}


def test_medians(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.lit(7.0)).alias("b"), F.lit(None).cast("double").alias("c"))
    assert {r.col: r.median for r in exact_median(df, ["a", "b", "c"]).collect()} == {"a": 500.0, "b": 7.0}
