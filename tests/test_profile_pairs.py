"""Pairs of profiles against brute force."""

import random
from collections import defaultdict
from itertools import product

import pytest

from tickerloom.operators import graph


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_profiles_meet_without_a_shuffle_of_pairs(spark):
    draw = random.Random(2)
    rows = [(f"s{i}", sector, draw.choice([0.95, 0.85, 0.75])) for i in range(60) for sector in draw.sample("ABCDEFG", 3)]
    rows += [("twice", "A", 0.2), ("twice", "A", 0.6), ("bare", "B", None), ("lost", None, 0.5)]
    edges = spark.createDataFrame(rows, "stock_code string, sector string, weight double").repartition(3)
    members = graph.profiles(edges)
    pairs = graph.profile_pairs(edges, members)
    text = plan(pairs)
    assert "Aggregate" not in text[: text.index("Join")]
    assert f", {spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_NUM" in text
    by_profile, held = defaultdict(list), defaultdict(list)
    for s, sector, weight in rows:
        held[s].append((sector, weight))
    for r in members.collect():
        by_profile[r.profile].append(r.stock_code)
    want = {}
    for (p, ps), (q, qs) in product(by_profile.items(), repeat=2):
        met = [(x, y) for (m, x), (n, y) in product(held[min(ps)], held[min(qs)]) if m == n and m is not None]
        if met:
            both = [(x + y) / 2 for x, y in met if x is not None and y is not None]
            want[p, q] = (sum(both) / len(both) if both else None, len(ps), len(qs))
    got = {(r.p1, r.p2): (r.corr, r.n1, r.n2) for r in pairs.collect()}
    assert got.keys() == want.keys()
    for k, (corr, *sizes) in want.items():
        assert got[k][1:] == tuple(sizes) and got[k][0] == (None if corr is None else pytest.approx(corr, abs=0.00051))
