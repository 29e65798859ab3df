"""The shape of results: rounding, zeros, and stages whose code the JVM compiles."""

from pyspark.sql import functions as F

from tickerloom.plans import registry


def test_zeros_are_not_rounded_and_keep_their_value(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.0D), (2, -0.0D), (3, 1.2345675D), (4, -1e-12D), (5, double('NaN')), (6, double('inf')), (7, NULL) t(k, v)")
    got = {r.k: r.v for r in registry.tidy(df).collect()}
    want = {r.k: r.w for r in df.select("k", (F.round(F.col("v") + 1e-9, 6) + 0.0).alias("w")).collect()}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
    plan = registry.tidy(spark.range(9).select(F.rand().alias("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and plan.index("CASE WHEN") < plan.index("round(")


def test_queries_keep_generated_methods_compilable(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    registry.query("probe")(lambda spark, sf: spark.range(1))
    try:
        registry.QUERIES.pop("probe")(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) <= 8000
    finally:
        spark.conf.set(key, before)
