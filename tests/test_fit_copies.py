"""Fits read the panel where it is; windows that repeat it are not copied."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickerloom.operators import ml, splits
from tickerloom.plans import registry


def panel(spark):
    rng = random.Random(4)
    rows = [(str(s), dt.date(2024, 1, 1) + dt.timedelta(d), rng.gauss(0, 1), float(rng.random() < 0.2), rng.gauss(0, 1)) for s in range(4) for d in range(150)]
    df = spark.createDataFrame(rows, "stock_code string, trade_date date, ret_5d double, news_count double, future_ret_5d double")
    return df.withColumn("label_up_5d", (F.col("ret_5d") + F.col("future_ret_5d") > 0).cast("int"))


def test_a_comparison_copies_neither_windows_nor_training_rows(spark, monkeypatch):
    parts = splits.rolling_splits(panel(spark), train=60, valid=10, test=10, step=20, windows=2)
    expected = {(r.window_id, r.feature_set): r for r in ml.compare_feature_sets(parts, maxIter=20)[0].collect()}
    written, write = [], ml.materialize
    monkeypatch.setattr(ml, "materialize", lambda df, name: written.append(name) or write(df, name))
    copied = write(parts, "parts")
    got = {(r.window_id, r.feature_set): r for r in ml.compare_feature_sets(copied, maxIter=20)[0].collect()}
    assert written == ["scored", "metrics"]
    assert sorted(got) == sorted(expected) and len(got) == 4
    assert all(abs(got[k][c] - expected[k][c]) < 1e-6 for k in got for c in ("auc", "logloss", "f1", "topk_hit_rate"))


def test_splits_do_not_shuffle_the_panel_by_date(spark, tmp_path):
    panel(spark).write.parquet(str(tmp_path / "panel"))
    written = spark.read.parquet(str(tmp_path / "panel"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a panel whose dates are estimated by its size
    try:
        plans = [s(written)._jdf.queryExecution().executedPlan().toString() for s in (splits.ratio_split, splits.tail_split, splits.rolling_splits)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)


def test_queries_on_made_up_frames_need_no_folder(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    registry.deal_by_size(spark, "")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_two_heads_copy_no_training_rows(spark, monkeypatch):
    written, write = [], ml.materialize
    monkeypatch.setattr(ml, "materialize", lambda df, name: written.append(name) or write(df, name))
    train = panel(spark).withColumn("future_ret_5d", F.col("ret_5d") / 100).withColumn("label_up_5d", (F.col("ret_5d") > 0).cast("int"))
    scored = ml.two_head(train, {"tech": ["ret_5d", "news_count"]}, max_iter=15).score(train)
    assert written == []
    up, down = (scored.filter(f"label_up_5d = {k}").agg(F.avg("probability"), F.avg("predicted_return")).first() for k in (1, 0))
    assert up[0] > down[0] + 0.5 and up[1] > down[1]
