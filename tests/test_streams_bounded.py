"""Streams over many files: state that goes, wrong dates that change nothing, unmatched items that stay, no input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.streaming import news as st
from tickerloom.streaming.run import run_available

SCHEMA = "news_id string, stock_code string, publish_time timestamp, arrived timestamp, sentiment double"
START = dt.datetime(2024, 3, 1, 9)


def items(wrong: bool):
    rows = []
    for day in range(20):
        at = START + dt.timedelta(days=day)
        batch = [(f"{day}-{k}", "000001", at - dt.timedelta(hours=20 * k), at, 0.5) for k in range(4)]
        if wrong and day == 3:
            batch += [("2100", "000001", dt.datetime(2100, 1, 1), at, 0.9), ("old", "000001", dt.datetime(2004, 1, 1), at, 0.9), ("none", "000001", None, at, 0.9)]
        rows.append(batch)
    return rows


def source(spark, tmp_path, wrong=True):
    import os

    for n, batch in enumerate(items(wrong)):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n:02d}")
        for f in os.listdir(f"{tmp_path}/in/part={n:02d}"):
            os.utime(f"{tmp_path}/in/part={n:02d}/{f}", (1_700_000_000 + 60 * n,) * 2)  # files are taken in order of their time
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")


def buckets(batches, back, ahead):
    out = {}
    for batch in batches:
        for _, code, at, arrived, _ in batch:
            if at is None or not arrived - back <= at <= arrived + ahead:
                continue
            end = at.replace(hour=15, minute=0)
            end = end if at <= end else end + dt.timedelta(days=1)
            out[code, end] = out.get((code, end), 0) + 1
    return out


@pytest.mark.parametrize("wrong", [False, True])
def test_state_is_bounded_and_wrong_dates_change_nothing(spark, tmp_path, wrong):
    kept, aside = st.split_by_age(source(spark, tmp_path, wrong), F.col("arrived"), "4 days", "1 day")
    counts = {}
    got = run_available(st.stream_daily_news(kept, "5 days"), "update", "t", ["stock_code", "close_ts"], counts)
    assert {(r.stock_code, r.close_ts): r.news_count for r in got.collect()} == buckets(items(False), dt.timedelta(days=4), dt.timedelta(days=1))
    assert counts["removed"] > 0 and counts["late"] == 0
    left = {r.reason: r.news_id for r in run_available(aside).collect()}
    assert left == ({"future": "2100", "stale": "old", "no time": "none"} if wrong else {})


def test_append_mode_closes_buckets(spark, tmp_path):
    kept, _ = st.split_by_age(source(spark, tmp_path), F.col("arrived"), "4 days", "1 day")
    closed = run_available(st.stream_daily_news(kept, "5 days")).collect()
    want = buckets(items(False), dt.timedelta(days=4), dt.timedelta(days=1))
    assert 0 < len(closed) < len(want) and all(want[r.stock_code, r.close_ts] == r.news_count for r in closed)


def test_unmatched_items_stay(spark, tmp_path):
    calendar = spark.createDataFrame([("000001", dt.date(2024, 3, 5)), ("000001", dt.date(2024, 3, 12))], "stock_code string, trade_date date")
    sdf = source(spark, tmp_path).withColumn("stock_code", F.when(F.col("news_id") == "7-0", "999999").otherwise(F.col("stock_code")))
    got = {r.news_id: r.trade_date for r in run_available(st.stream_effective_day(sdf, st.effective_days(calendar))).collect()}
    assert len(got) == 83
    assert got["old"] == got["0-0"] == dt.date(2024, 3, 5) and got["6-0"] == dt.date(2024, 3, 12)
    assert got["2100"] is None and got["none"] is None and got["7-0"] is None and got["19-0"] is None


@pytest.mark.parametrize("mode", ["append", "update"])
def test_no_input(spark, tmp_path, mode):
    import os

    os.makedirs(f"{tmp_path}/empty")
    sdf = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/empty")
    got = run_available(st.stream_freshness(sdf, F.lit("2024-01-01").cast("timestamp")), mode, "e", ["news_id"])
    assert got.count() == 0 and got.columns == sdf.columns
