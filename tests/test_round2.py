"""Long gaps and steep decay, deep pages, refused selectors, streams over many batches in any order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators.ewm import ewm
from tickerloom.sources import feeds
from tickerloom.streaming import news as st
from tickerloom.streaming.run import run_available


def test_ewm_equals_pandas(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal(3000) * 3 + 1
    x[400:1900] = np.nan
    x[:4] = np.nan
    spans = [1.05, 1.1, 3, 12, 60]
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "stock_code string, trade_date int, x double")
    got = ewm(df, {"x": [(f"y{i}", s) for i, s in enumerate(spans)]}).toPandas().sort_values("trade_date")
    for i, s in enumerate(spans):
        want = pd.Series(x).ewm(span=s, adjust=False).mean()
        assert np.allclose(got[f"y{i}"], want, rtol=0, atol=1e-9, equal_nan=True)


def test_deep_page():
    tree = feeds._Tree("<div>" * 50_000 + "deep<script>no</script>")
    assert tree.root.text() == "deep" and sum(1 for _ in tree.root.walk()) == 50_001


@pytest.mark.parametrize("selector", ["ul > li", "a[href]", "h2, h3", "li:first-child"])
def test_unsupported_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        feeds._compounds(selector)


def test_field_rules():
    node = feeds._Tree('<div id="x"><a class="b" href="/u">t</a></div>').root
    assert feeds._field(node, "a.b") == "t" and feeds._field(node, {"selector": "a", "attr": "href"}) == "/u"
    assert feeds._field(node, {"value": " c "}) == "c" and feeds._field(node, {"selector": "p", "default": "d"}) == "d" and feeds._field(node, None) == ""


@pytest.fixture
def shuffled(spark, tmp_path):
    """Three files, the latest day first; one bucket is strong in the first batch and mild after the last."""
    rows = [[("c", "2001-01-20 12:00:00", 0.9), ("c", "2001-01-20 12:00:00", 0.9)], [("a", "2001-01-05 12:00:00", 0.9)], [("b", "2001-01-05 13:00:00", -0.9), ("d", "2001-01-01 09:00:00", 0.1)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "news_id string, ts string, sentiment double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"{i}"))
    s = spark.readStream.schema("news_id string, ts string, sentiment double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    return s.select("news_id", F.lit("000001").alias("stock_code"), F.col("ts").cast("timestamp").alias("publish_time"), "sentiment")


def test_streams_over_many_batches(shuffled):
    assert sorted(r.news_id for r in run_available(st.stream_news_dedupe(shuffled)).collect()) == ["a", "b", "c", "d"]
    latest = run_available(st.stream_shock_alert(shuffled), "update", "t", ["stock_code", "close_ts"])
    assert sorted(r.news_count for r in latest.collect()) == [1, 2, 2]
    assert [r.news_count for r in st.shock_rows(latest).collect()] == [2]
