"""Registered models at the operators' defaults, context of every keyword hit."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from tickerloom.operators import ml
from tickerloom.plans import load, model_queries as mq, text_queries as tq


def test_registered_models_take_the_defaults(spark, monkeypatch):
    seen = []

    class Stub:
        def score(self, df):
            return df.withColumns({c: F.lit(0.5) for c in ("pred_prob", "probability", "predicted_return")})

    def fit(name):
        return lambda train, cols, *a, **kw: seen.append((name, a, kw)) or Stub()

    row = ("1", dt.date(2024, 1, 1), 0.1, 1, "test", *[0.0] * len(mq.ML_COLS))
    schema = "stock_code string, trade_date date, future_ret_5d double, label_up_5d int, split string, " + ", ".join(f"{c} double" for c in mq.ML_COLS)
    parts = spark.createDataFrame([row], schema)
    monkeypatch.setattr(mq, "ml_parts", lambda *_: parts)
    monkeypatch.setattr(ml, "fit_classifier", fit("classifier"))
    monkeypatch.setattr(ml, "two_head", fit("two_head"))
    for name in ("h7_random_forest", "h8_boosted_trees", "h9_two_head"):
        assert load()[0][name](spark, "").count() == 1
    assert seen == [("classifier", (), {"kind": "random_forest"}), ("classifier", (), {"kind": "boosted_trees"}), ("two_head", (), {})]


def test_comparison_returns_its_three_results(spark, monkeypatch):
    def compare(parts, *a, **kw):
        assert not a and not kw
        return [spark.createDataFrame([(1,)], f"{c} int") for c in ("auc", "uplift_auc", "windows")]

    panel = spark.createDataFrame([], "stock_code string, trade_date date, label_up_5d boolean, open double, high double, low double, close double, volume double")
    news = spark.createDataFrame([], "stock_code string, trade_date date, news_count int, weighted_sentiment double, news_impact_total double")
    monkeypatch.setattr(mq.fx, "market", lambda *_: None)
    monkeypatch.setattr(mq.technical, "technical_panel", lambda _: panel)
    monkeypatch.setattr(mq, "daily", lambda *_: news)
    monkeypatch.setattr(ml, "compare_feature_sets", compare)
    got = load()[0]["h12_compare_feature_sets"](spark, "").collect()
    assert [(r.result, r.auc, r.uplift_auc, r.windows) for r in got] == [("metrics", 1, None, None), ("uplift", None, 1, None), ("summary", None, None, 1)]


def test_training_rows_are_spread(spark):
    assert ml._spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= 4


def test_every_hit_of_the_content_is_judged(spark, monkeypatch):
    text = "of for, " + "x" * 50 + " in this and " + "x" * 50 + " for one of in for, plain end"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "arrival long, content string")
    monkeypatch.setattr(tq.fx, "docs", lambda *_: docs)
    got = {(r.arrival, r.word): (r.hits, r.modifier) for r in load()[0]["b35_context_modifier_hits"](spark, "").collect()}
    assert got == {(1, "for"): (3, -1.2), (1, "this"): (1, 1.2)}
    # with the SQL, on the smallest tables
    name, con = "b35_context_modifier_hits", duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    monkeypatch.undo()
    key = lambda r: (r["arrival"], r["word"])
    got = sorted((r.asDict() for r in load()[0][name](spark, "/root/testdata/sf0.001").collect()), key=key)
    want = sorted(con.sql(load()[1][name]).df().to_dict("records"), key=key)
    assert got == want and len(got) > 100
