"""What keeps the figures of a task and of a shuffle in step with the input."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickerloom.functions.technical import by_stock
from tickerloom.operators import encode, matching, ordered, technical
from tickerloom.operators.ewm import ewm
from tickerloom.plans import registry

R = random.Random(3)
BARS = "stock_code string, trade_date date, open double, high double, low double, close double, volume double"


def plan(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, k, R.choice([None, R.uniform(1, 50)]) if s == "b" else R.uniform(1, 50)) for s, n in (("a", 300), ("b", 130), ("c", 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "stock_code string, k int, close double")
    day = F.date_add(F.lit("2001-01-01").cast("date"), F.col("k"))
    return df.select("stock_code", day.alias("trade_date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(5.0).alias("volume"))


def test_indicators_sort_twice(bars):
    """One sort by day and one by segment, for both exponential means."""
    assert plan(technical.technical_panel(bars)).count("- Sort [") == 2
    assert plan(technical.tech_snapshot(bars)).count("- Sort [") == 3


def test_spans_far_apart_keep_segments_of_their_own(spark):
    df = spark.range(3000).select(F.lit("a").alias("stock_code"), F.col("id").alias("trade_date"), F.rand(1).alias("x"))
    got = ewm(df, {"x": [("quick", 1.5), ("slow", 400)]}).orderBy("trade_date").collect()
    for name, span in (("quick", 1.5), ("slow", 400)):
        alpha, y = 2 / (span + 1), got[0].x
        for r in got:
            y = y + alpha * (r.x - y)
            assert abs(r[name] - y) < 1e-9


def test_recent_history(bars):
    for days, least in ((200, 60), (50, 50), (50, 51), (1000, 1)):
        want = technical.min_history(technical.tail_days(bars, days), least)
        got = technical.recent_history(bars, days, least)
        key = lambda df: sorted((r.stock_code, r.trade_date) for r in df.collect())
        assert key(got) == key(want) and got.columns == bars.columns


def test_snapshot_equals_windows_over_all_rows(bars):
    got = {r.stock_code: r.tech for r in technical.tech_snapshot(bars).collect()}
    w = by_stock()
    low, high = F.min("close").over(w.rowsBetween(-59, 0)), F.max("close").over(w.rowsBetween(-59, 0))
    last = bars.withColumns({"lo": low, "hi": high}).groupBy("stock_code").agg(F.max_by(F.struct("close", "lo", "hi"), "trade_date").alias("r"))
    for r in last.collect():
        c, lo, hi = r.r
        if c is not None:
            assert got[r.stock_code][8] == pytest.approx((c - lo) / (hi - lo))


def test_rows_to_rank_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(x):
        made.add(1)
        return x % 7

    df = spark.range(500).select(F.col("id").alias("k"), count("id").alias("s"))
    assert ordered.global_rank(df, "s", "k").count() == 500
    assert made.value == 500


def test_median_ranks_only_the_middle(spark, monkeypatch):
    seen, plain = [], ordered.running_total

    def spied(df, *args, **kw):
        seen.append(df.count())
        return plain(df, *args, **kw)

    monkeypatch.setattr(ordered, "running_total", spied)
    rows = [(float(i), float(i % 2), None, 1.5) for i in range(9_999)] + [(float("nan"), 1.0, None, 1.5), (float("inf"), 0.0, None, 1.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {r.col: r.median for r in ordered.exact_median(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": 4999.5, "b": 0.0, "d": 1.5}
    assert seen[0] < 300


def test_median_of_few_values(spark):
    for n in range(1, 40):
        values = [float(R.randint(0, 20)) for _ in range(n)]
        s = sorted(values)
        df = spark.createDataFrame([(v,) for v in values], "a double")
        if n % 5 == 1 or n < 6:
            assert ordered.exact_median(df, ["a"]).first().median == (s[(n - 1) // 2] + s[n // 2]) / 2


@pytest.mark.parametrize("known", [1 << 20, 0])
def test_grams_are_counted_before_the_shuffle(spark, monkeypatch, known):
    monkeypatch.setattr(encode, "KNOWN", known)
    news = spark.createDataFrame([("s", "abc", "de" * 50), ("t", "é", None)], "stock_code string, title string, content string")
    found = encode.text_hash_counts(news)
    assert plan(found).count("Exchange hashpartitioning(") == 1
    want = Counter()
    for code, t in (("s", "abc " + "de" * 50), ("t", "é")):
        for k in (2, 3, 4):
            want.update((code, int(hashlib.md5(t[i : i + k].encode()).hexdigest()[:8], 16) % 112) for i in range(len(t) - k + 1))
    assert {(r.stock_code, r.pos): r.n for r in found.collect()} == want


def test_matched_pairs_are_not_shuffled(spark):
    news = spark.createDataFrame([("n1", "abc", "d" * 500)], "news_id string, title string, content string")
    aliases = spark.createDataFrame([("000001", "abc"), ("000002", "abc")], "code string, alias string")
    found = matching.match_news_to_stocks(news, aliases)
    text = plan(found.select("stock_code", "news_id", "relevance"))
    assert "hashpartitioning(news_id" in text
    assert "hashpartitioning(_anchor" not in text and "hashpartitioning(code" not in text
    assert {(r.stock_code, r.relevance) for r in found.collect()} == {("000001", 0.9), ("000002", 0.9)}


def test_more_aliases_than_are_sent(spark, monkeypatch):
    news = spark.createDataFrame([(f"n{i}", f"x{i}", f"ab{i % 3} 00000{i}") for i in range(8)], "news_id string, title string, content string")
    aliases = spark.createDataFrame([(f"00000{i}", a) for i in range(5) for a in (f"ab{i}", f"00000{i}", f"x{i}")], "code string, alias string")
    rows = lambda: sorted((r.stock_code, r.news_id, r.relevance) for r in matching.match_news_to_stocks(news, aliases).collect())
    want = rows()
    monkeypatch.setattr(matching, "SENT", 0)
    assert rows() == want and len(want) > 8


def test_partitions_follow_the_input(spark, tmp_path):
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        registry.deal_by_size(spark, str(tmp_path))
        assert spark.conf.get("spark.sql.shuffle.partitions") == keep["spark.sql.shuffle.partitions"]
        with open(tmp_path / "large", "wb") as f:
            f.truncate(400 << 20)
        registry.deal_by_size(spark, str(tmp_path))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 50
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_item_texts_are_read_before_pairs(spark):
    """Items that went through text_item_stats carry no text and give the same vectors."""
    rows = [("a", "up!", "ab up", 0.5), ("a", None, "cd down?", None), ("b", "", None, 0.1)]
    news = spark.createDataFrame(rows, "stock_code string, title string, content string, sentiment double")
    items = encode.text_item_stats(news, ["up"], ["down"])
    assert not {"title", "content"} & set(items.columns)
    vectors = lambda n: sorted((r.stock_code, r.text_stats) for r in encode.encode_text_stats(n, ["up"], ["down"]).collect())
    assert vectors(items) == vectors(news)
