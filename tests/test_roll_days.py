"""The lookup of trade days holds what was asked for, not the calendar."""

from pyspark.sql import functions as F

from tickerloom.operators import calendar as cal


def test_only_asked_days_are_looked_up(spark):
    day = lambda c: F.date_add(F.lit("2001-01-01").cast("date"), c)
    open_days = spark.range(400).select(F.lit("000001").alias("stock_code"), day((F.col("id") * 2).cast("int")).alias("trade_date"))
    asked = spark.createDataFrame([("000001", 3), ("000001", 4), ("000001", 900), ("000002", 1)], "stock_code string, n int").select("stock_code", day(F.col("n")).alias("_day"))
    found = {(r.stock_code, str(r._day)): str(r.trade_date) for r in cal._roll(asked, open_days, "next").collect()}
    assert found == {("000001", "2001-01-04"): "2001-01-05", ("000001", "2001-01-05"): "2001-01-05", ("000001", "2003-06-20"): "None", ("000002", "2001-01-02"): "None"}
    back = {(r.stock_code, str(r._day)): str(r.trade_date) for r in cal._roll(asked, open_days, "before").collect()}
    assert back[("000001", "2001-01-04")] == "2001-01-03" and back[("000001", "2003-06-20")] == "2003-03-10" and len(back) == 4
