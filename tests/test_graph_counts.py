"""Graph operators without pairs, against plain loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import graph

R = random.Random(6)
WEIGHTS = [0.95, 0.85, 0.75, 0.6, 0.123]


def made(stocks, sectors, hot):
    out = {}
    for k in range(stocks):
        held = set(R.sample(sectors, R.randint(1, 4)))
        if R.random() < hot:
            held.add("hot")
        out[f"{k:06d}"] = {s: R.choice(WEIGHTS) for s in held}
    return out


def corr(a, b):
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    total = sum(round(a[s] * 10**6) + round(b[s] * 10**6) for s in both)
    return (total * 1000 + len(both) * 10**6) // (len(both) * 2 * 10**6) / 1000


def frames(spark, held):
    edges = spark.createDataFrame([(c, s, w) for c, h in held.items() for s, w in h.items()], "stock_code string, sector string, weight double")
    codes = spark.createDataFrame([(c, f"n{c}", "i") for c in [*held, "999999"]], "stock_code string, name string, industry string")
    return edges, codes


@pytest.fixture(scope="module")
def market():
    held = made(90, [f"s{k}" for k in range(7)], 0.6)
    held |= {f"1{k:05d}": {"s0": 0.95, "s1": 0.85} for k in range(30)}  # one kind of many stocks
    # few hold x alone, behind many that hold x and y: the first codes of x do not suffice
    held |= {f"2{k:05d}": {"x": 0.85, "y": 0.75, **({f"z{k}": 0.6} if k % 2 else {})} for k in range(80)}
    return held | {f"3{k:05d}": {"x": 0.85, f"q{k}": 0.9} for k in range(4)} | {"400000": {"lone": 0.5}}


def test_summary_and_vectors(spark, market):
    edges, codes = frames(spark, market)
    n = len(market) + 1
    rows = {c: sorted((corr(h, g) for d, g in market.items() if d != c), reverse=True) + [0.0] for c, h in market.items()} | {"999999": [0.0] * (n - 1)}
    for r in graph.relevance_summary(edges, codes).collect():
        row = rows[r.stock_code]
        mean = sum(row) / len(row)
        std = math.sqrt(sum((x - mean) ** 2 for x in row) / len(row))
        want = mean, max(row), std, sum(x > 0.5 for x in row) / len(row)
        assert (r.relevance_mean, r.relevance_max, r.relevance_std, r.relevance_strong_ratio) == pytest.approx(want, abs=1e-7)
    vectors = {r.stock_code: r.relevance for r in graph.encode_relevance_features(edges, codes).collect()}
    assert len(vectors) == n
    for c, row in rows.items():
        full = sorted([1.0, *row], reverse=True)
        mean = sum(full) / n
        std = math.sqrt(sum((x - mean) ** 2 for x in full) / n)
        want = [mean, 1.0, std, sum(x > 0.5 for x in full) / n, sum(x > 0.7 for x in full) / n, *full[:10], 0.0]
        assert vectors[c] == pytest.approx(want, abs=1e-7)
    for c in ("000003", "100004", "200001", "300002", "400000", "999999"):
        assert graph.encode_relevance_of(c, edges, codes).first().relevance == pytest.approx(vectors[c], abs=1e-9)


def test_related_stocks(spark, market):
    edges, codes = frames(spark, market)
    got = {}
    for r in graph.related_stocks(edges, codes, 10, 0.3).collect():
        got.setdefault(r.stock_code, []).append((r.rank, r.code, r.corr))
    for c, h in market.items():
        peers = sorted((-corr(h, g), d) for d, g in market.items() if d != c and corr(h, g) >= 0.3)[:10]
        assert sorted(got.get(c, [])) == [(k + 1, d, -x) for k, (x, d) in enumerate(peers)]


def test_hot_sector_is_linear(spark):
    """Every stock of a large market holds the hot sector with a sector of its own: no pair is formed."""
    n = 20_000
    code = F.format_string("%06d", "id")
    base = spark.range(n)
    edges = base.select(code.alias("stock_code"), F.lit("hot").alias("sector"), F.lit(0.95).alias("weight")).union(
        base.select(code, F.concat(F.lit("own"), "id"), F.lit(0.75))
    )
    codes = base.select(code.alias("stock_code"))
    one = graph.relevance_summary(edges, codes).agg(F.count("*"), F.min("relevance_mean"), F.max("relevance_std")).first()
    assert one[0] == n and one[1] == pytest.approx(0.95) and one[2] < 1e-6


def test_too_many_sectors_raise(spark):
    edges = spark.createDataFrame([("000001", f"s{k}", 0.5) for k in range(graph.MOST_SECTORS + 1)], "stock_code string, sector string, weight double")
    with pytest.raises(Exception, match="more than"):
        graph.relevance_summary(edges, edges.select("stock_code").distinct()).collect()


def test_empty_graph(spark):
    edges, codes = frames(spark, {"000001": {"s": 0.5}})
    assert [tuple(r)[1:] for r in graph.relevance_summary(edges.limit(0), codes).collect()] == [(0.0, 0.0, 0.0, 0.0)] * 2
    assert graph.related_stocks(edges.limit(0), codes).count() == 0
