"""Edge cases against small pandas or plain Python restatements."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import codes, maths, text as tx, timing
from tickerloom.operators import backtest, calendar as cal, dedupe, graph, metrics, splits, technical
from tickerloom.operators.ewm import ewm
from tickerloom.operators.matching import build_alias_dim, match_news_to_stocks
from tickerloom.operators.ordered import exact_median, running_total, with_bucket

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def bars(spark, closes, code="000001"):
    rows = [(code, day(i), c, c, c, c, 100.0 + i % 7) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "stock_code string, trade_date date, open double, high double, low double, close double, volume double")


def series(df, col):
    return np.array([np.nan if r[col] is None else r[col] for r in df.orderBy("trade_date").collect()], dtype=float)


@pytest.mark.parametrize("n", [1, 5, 700])
def test_ewm_equals_pandas_with_gaps(spark, n):
    rng = random.Random(n)
    xs = [None if rng.random() < 0.1 and i else rng.uniform(-5, 5) for i in range(n)]
    rows = [("a", day(i), x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "stock_code string, trade_date date, x double")
    got = ewm(df, {"x": [("e3", 3), ("e26", 26)]})
    s = pd.Series(xs, dtype=float)
    for name, span in (("e3", 3), ("e26", 26)):
        np.testing.assert_allclose(series(got, name), s.ewm(span=span, adjust=False).mean().to_numpy(), rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("n", [13, 14, 19, 20, 21, 65])
def test_technical_panel_equals_pandas(spark, n):
    rng = random.Random(n)
    closes = [round(rng.uniform(5, 15), 2) for _ in range(n)]
    closes[4] = closes[8] = closes[9] = 0.0
    got = technical.technical_panel(bars(spark, closes))
    c = pd.Series(closes).replace(0, np.nan)
    filled = c.ffill()
    v = pd.Series([100.0 + i % 7 for i in range(n)])
    r = filled / filled.shift(1) - 1
    d = c.diff()
    gain, loss = d.where(d > 0, 0.0).rolling(14).mean(), (-d.where(d < 0, 0.0)).rolling(14).mean()
    sd, ma = c.rolling(20).std(), c.rolling(20).mean()
    want = {
        "ret_1d": r,
        "ret_20d": filled / filled.shift(20) - 1,
        "vol_5d": r.rolling(5).std(),
        "rsi": (100 - 100 / (1 + gain / (loss + 1e-10))) / 100,
        "macd": (c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()) / c,
        "bb_position": (c - (ma - 2 * sd)) / (4 * sd + 1e-10),
        "ma5_gt_ma10": (c.rolling(5).mean() > c.rolling(10).mean()).astype(float),
        "volume_ratio": v / v.rolling(20).mean(),
        "future_ret_5d": c.shift(-5) / c - 1,
    }
    for name, s in want.items():
        np.testing.assert_allclose(series(got, name), s.to_numpy(dtype=float), rtol=1e-8, atol=1e-9, err_msg=name)


def test_flat_series(spark):
    got = technical.technical_panel(bars(spark, [10.0] * 25)).filter("trade_date = '2024-01-25'").first()
    assert got.rsi == 0.0 and got.bb_position == 0.0 and got.ma5_gt_ma10 == 0.0
    snap = technical.tech_snapshot(bars(spark, [10.0] * 25)).first().tech
    assert snap[8] == 0.5 and snap[9] == -1.0
    assert technical.tech_snapshot(bars(spark, [10.0] * 19)).first().tech == [0.0] * 12


def test_features_ignore_the_future(spark):
    rng = random.Random(1)
    closes = [rng.uniform(5, 15) for _ in range(60)]
    cut = technical.technical_panel(bars(spark, closes[:40]), label=False).orderBy("trade_date").collect()
    full = technical.technical_panel(bars(spark, closes), label=False).filter("trade_date < '2024-02-10'").orderBy("trade_date").collect()
    assert len(cut) == len(full) == 40
    for a, b in zip(cut, full):
        for x, y in zip(a, b):
            assert x == y or x == pytest.approx(y, rel=1e-12)


def test_alignment_borders(spark):
    calendar = spark.createDataFrame([("1", day(1)), ("1", day(2)), ("1", day(5))], "stock_code string, trade_date date")
    t = lambda i, h, m=0, s=0: dt.datetime(2024, 1, 1 + i, h, m, s)
    cases = [
        ("close", t(1, 15), day(1)),
        ("late", t(1, 15, 0, 1), day(2)),
        ("closed", t(3, 9), day(5)),
        ("before", t(0, 23), day(1)),
        ("after", t(5, 15, 0, 1), None),
        ("none", None, None),
    ]
    news = spark.createDataFrame([(n, "1", ts) for n, ts, _ in cases], "news_id string, stock_code string, publish_time timestamp")
    got = {r.news_id: r.trade_date for r in cal.align_news(news, calendar).collect()}
    assert got == {n: d for n, _, d in cases if d is not None}


def greedy(items):
    """One item at a time: the first known key decides the slot."""
    where, slots = {}, {}
    for arr, keys in items:
        if not keys:
            continue
        slot = next((where[k] for k in keys if k in where), arr)
        slots[arr] = slot
        for k in keys:
            where[k] = slot
    return slots


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slots_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        title = rng.choice(["", "hot", "hot", "hot", *[f"t{j}" for j in range(15)]])
        ts = None if rng.random() < 0.1 else dt.datetime(2024, 1, rng.randint(1, 3), rng.randint(0, 23), rng.choice([1, 29, 30, 59]))
        url = rng.choice(["", "bad", f"https://X.com/{rng.randint(0, 20)}?q={i}"])
        rows.append((i, rng.choice(["", f"n{rng.randint(0, 150)}"]), title, ts, url, "c" * rng.randint(0, 5), rng.choice([0.1, 0.5])))
    df = spark.createDataFrame(rows, "arrival long, news_id string, title string, publish_time timestamp, url string, content string, importance double")
    items = []
    for i, nid, title, ts, url, _, _ in rows:
        keys = [f"id::{nid}"] if nid else []
        if title:
            if ts is None:
                keys.append(f"t::{title}")
            else:
                half = ts.replace(minute=30 * (ts.minute // 30))
                keys += [f"b::{title}{half}", f"d::{title}{ts.date()}"]
            if url.startswith("https"):
                keys.append("u::" + url.split("?")[0].lower())
        items.append((i, keys))
    want = greedy(items)
    got = {r.arr: r.slot for r in dedupe.news_slots(df, bits=3).collect()}
    assert got == want
    best = {}
    for i, *_, url, content, imp in rows:
        if i in want:
            q = len(content) + imp * 120 + (15 if url.startswith("https") else 0)
            if want[i] not in best or q > best[want[i]][0]:
                best[want[i]] = (q, i)
    kept = {r.arrival for r in dedupe.multi_key_dedupe(df, bits=3).collect()}
    assert kept == {i for _, i in best.values()}


def test_running_total_and_buckets(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randint(0, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r.g, r.o): (r.cum_v, r.all_v) for r in running_total(df, "o", ["v"], by=["g"], bits=4).collect()}
    sums, totals = {}, {}
    for g, _, v in rows:
        totals[g] = totals.get(g, 0) + v
    for g, o, v in rows:
        sums[g] = sums.get(g, 0) + v
        assert got[g, o] == (sums[g], totals[g])
    sizes = with_bucket(df.filter("g = 'hot'"), "o", bits=4).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 200


def test_median_and_auc_with_ties(spark):
    vals = [1.0, 2.0, 2.0, 3.0, None, 10.0, 7.0]
    df = spark.createDataFrame([(v, 1.0) for v in vals], "a double, b double")
    got = {r["col"]: r["median"] for r in exact_median(df, ["a", "b"]).collect()}
    assert got == {"a": 2.5, "b": 1.0}
    rng = random.Random(3)
    pts = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in pts if y for z, b in pts if not z]
    s = spark.createDataFrame(pts, "y int, s double")
    assert metrics.roc_auc(s, "y", "s").first().auc == pytest.approx(np.mean(pairs))
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert metrics.roc_auc(one, "y", "s").first().auc == 0.5
    assert metrics.log_loss(one, "y", "s").first().logloss == 0.0


def keyword_by_hand(text, title, pos, neg, negation, intensify):
    score = 0.0
    for sign, words in ((1, pos), (-1, neg)):
        for w, weight in words.items():
            at = text.find(w)
            while at >= 0:
                ctx = text[max(0, at - 8) : at]
                m = -1.0 if any(x in ctx for x in negation) else 1.0
                m *= 1.2 if any(x in ctx for x in intensify) else 1.0
                score += sign * weight * m * (1.15 if w in title else 1.0)
                at = text.find(w, at + len(w))
    return float(np.tanh(score / 4))


def test_keyword_sentiment_default_words(spark):
    texts = [
        ("公司业绩增长", "公司业绩增长 利润未大幅增长，持续上涨"),
        ("", "没有增长增长增长，亏损风险"),
        ("下跌", "大幅下跌不会持续很久再下跌"),
        ("x", "无关"),
    ]
    from tickerloom.functions import defaults as d

    df = spark.createDataFrame(texts, "title string, t string")
    got = [r[0] for r in df.select(tx.keyword_sentiment(F.col("t"), F.col("title"))).collect()]
    want = [keyword_by_hand(t, ti, d.POSITIVE_WORDS, d.NEGATIVE_WORDS, d.NEGATION_WORDS, d.INTENSIFY_WORDS) for ti, t in texts]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_self_overlapping_word(spark):
    df = spark.createDataFrame([("", "no aaaa"), ("", "aaa no aaa")], "title string, t string")
    got = [r[0] for r in df.select(tx.keyword_sentiment(F.col("t"), F.col("title"), {"aa": 1.0}, {}, ["no"], [])).collect()]
    want = [keyword_by_hand(t, "", {"aa": 1.0}, {}, ["no"], []) for t in ("no aaaa", "aaa no aaa")]
    np.testing.assert_allclose(got, want, atol=1e-12)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_scalars(spark):
    lit = F.lit
    r = one(
        spark,
        pad=codes.pad_code(lit(" 42 ")),
        long=codes.pad_code(lit("1234567")),
        digits=codes.digits_code(lit("sh0000001")),
        none=codes.digits_code(lit("abc")),
        suffix=codes.strip_company_suffix(lit("平安股份有限公司")),
        url=codes.normalize_url(lit("//Ex.COM:80/a/b/?q=1#f")),
        ftp=codes.normalize_url(lit("ftp://x/y")),
        slug=codes.slug(lit("  Ab c!!d ")),
        html=tx.strip_html(lit("<b>a</b>\n　 b")),
        bucket=timing.bucket_30m(lit("2024-01-01 10:59:59").cast("timestamp")).cast("string"),
        ts=timing.parse_timestamp(lit("Mon, 01 Jan 2024 10:00:00 +0800")).cast("string"),
        bad=timing.parse_timestamp(lit("soon")),
        half=maths.round_half_up(lit(-0.125), 2),
        nan=maths.safe_float(lit(float("nan")), 7.0),
        fit=maths.fit_width(F.array(lit(1.0)), 3),
    )
    assert r.pad == "000042" and r.long == "1234567" and r.digits == "000001"
    assert r.none is None and r.suffix == "平安"
    assert r.url == "https://ex.com:80/a/b" and r.ftp == "" and r.slug == "ab_c_d" and r.html == "a b"
    assert r.bucket == "2024-01-01 10:30:00" and r.ts == "2024-01-01 02:00:00" and r.bad is None
    assert r.half == -0.13 and r.nan == 7.0 and r.fit == [1.0, 0.0, 0.0]


def test_matching_rules(spark):
    dim = build_alias_dim(spark.createDataFrame([("1", "Acme Corp H"), ("2", "Bolt")], "code string, name string"))
    long = "x" * 40
    extra = spark.createDataFrame([("000003", long)], "code string, alias string")
    news = spark.createDataFrame(
        [("a", "acme-corp wins", ""), ("b", "none", "about 000001 and Bolt"), ("c", "zzz", "y" + long), ("d", "z", "x" * 39)],
        "news_id string, title string, content string",
    ).withColumn("publish_time", F.current_timestamp())
    got = {(r.stock_code, r.news_id): r.relevance for r in match_news_to_stocks(news, dim.unionByName(extra)).collect()}
    assert got == {("000001", "a"): 0.9, ("000001", "b"): 0.8, ("000002", "b"): 0.8, ("000003", "c"): 0.8}


def test_graph_edge_cases(spark):
    edges = spark.createDataFrame(
        [("1", "A", 0.9), ("1", "B", 0.5), ("2", "A", 0.7), ("3", "A", 0.7), ("4", "Z", 1.0)], "stock_code string, sector string, weight double"
    )
    codes_df = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("5",)], "stock_code string")
    s = {r.stock_code: r for r in graph.relevance_summary(edges, codes_df).collect()}
    assert s["1"].relevance_mean == pytest.approx(0.4) and s["2"].relevance_max == pytest.approx(0.8)
    assert s["4"].relevance_mean == s["5"].relevance_max == 0.0
    v = {r.stock_code: r.relevance for r in graph.encode_relevance_features(edges, codes_df).collect()}
    assert v["2"][5:9] == [1.0, 0.8, 0.7, 0.0] and v["5"][0] == pytest.approx(0.2)
    pairs = {(r.code1, r.code2): r["corr"] for r in graph.stock_pair_correlation(edges).collect()}
    assert pairs[("2", "3")] == 0.7 and ("1", "4") not in pairs
    alone = graph.relevance_summary(edges, codes_df.filter("stock_code = '1'")).first()
    assert alone.relevance_mean == 0.0 and alone.relevance_std == 0.0


def test_backtest_days(spark):
    rows = []
    for d, held in enumerate([["a", "b"], ["a", "b"], ["c", "d"]]):
        rows += [(c, day(d), 1.0 if c in held else 0.0, 0.02, 1) for c in "abcd"]
    scored = spark.createDataFrame(rows, "stock_code string, trade_date date, pred_prob double, future_ret_5d double, label_up_5d int")
    out = backtest.cross_section_backtest(scored, top_n=2)
    h = out["holdings"].orderBy("trade_date").collect()
    assert [r.turnover for r in h] == [1.0, 0.0, 1.0]
    assert [round(r.trade_cost, 6) for r in h] == [0.0005, 0.0, 0.002]
    s = out["summary"].first()
    assert s.cumulative_return == pytest.approx(1.0195 * 1.02 * 1.018 - 1) and s.max_drawdown == 0.0


def test_splits_are_disjoint_and_ordered(spark):
    rows = [(str(s), day(d)) for d in range(100) for s in range(2)]
    df = spark.createDataFrame(rows, "stock_code string, trade_date date")
    for split in (splits.ratio_split(df), splits.tail_split(df), splits.row_tail_split(df)):
        r = {x.split: (x.lo, x.hi, x.n) for x in split.groupBy("split").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"), F.count("*").alias("n")).collect()}
        assert r["train"][1] <= r["valid"][0] <= r["valid"][1] <= r["test"][0]
        assert sum(x[2] for x in r.values()) == 200
    with pytest.raises(Exception, match="too few"):
        splits.ratio_split(df.filter("trade_date < '2024-02-01'")).collect()
    assert splits.rolling_splits(df).count() == 0
