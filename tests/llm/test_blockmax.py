"""Ranked search against a plain ranking of all documents; pruning really skips blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickerloom.llm import blockmax as bm, common

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
R = random.Random(11)
VOCAB = [f"w{int(R.paretovariate(0.6))}é" for _ in range(4000)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


TEXTS = [None, "", " .\x00", "One one ONE, two", "one one one two", "É é ÉÉ", *[prose(R.randint(1, 60)) for _ in range(500)], prose(8000), " ".join(["w1é"] * 500)]
DOCS = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "one two", 1, "x"), (7, "one two", 1, "x"), (7, "one two", 1, "x"), (None, "one two", 1, "x")]
ITEMS = [(0, "one two two"), (0, "one"), (None, "two"), (1, None), (2, "..."), (3, "nowhere"), (4, "É w1é"), *[(10 + i, prose(R.randint(1, 30))) for i in range(25)], (99, prose(400))]


def lowered(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    rows = [(i, lowered(t)) for i, t, *_ in docs]
    rows = [(i, w, Counter(w)) for i, w in rows if w]
    n_docs, n_terms = len(rows), sum(len(w) for _, w, _ in rows)
    df = Counter(t for _, _, c in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, w, c in rows:
            m = 25 + (75 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in lowered(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, rank int, term string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("kw", [{}, {"shard_postings": 700}, {"item_bytes": 100, "top": 3}])
def test_against_plain_ranking(tables, kw):
    got = bm.search(*tables, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(DOCS, ITEMS, kw.get("top", 10))


def test_wanted_terms_alone_give_the_same(tables):
    wanted = {t for _, text in ITEMS for t in bm.terms(text)}
    assert sorted(map(tuple, bm.search(*tables, wanted=wanted).collect()), key=str) == plain(DOCS, ITEMS)
    assert bm.search(*tables, wanted={b"nowhere"}).count() == 0


def test_pruning_is_exact_and_skips_blocks():
    words = [b"t%d" % k for k in range(30)]
    skipped = 0
    for _ in range(5):
        w = bm.ShardWriter(None)
        for i in range(12_000):
            w.add(i * 7 % 12_000, [x for k, x in enumerate(words) for _ in range(R.randint(1, 3)) if R.random() < 1.0 / (k + 1) ** 1.3] or [b"z"])
        rows = {r["term"]: r for r in w.batch().to_pylist()}
        head = rows.pop(None)
        ids, lengths = (np.array(head[k], np.int64) for k in ("ids", "lengths"))
        totals = (len(ids), int(lengths.sum()))
        m = bm.shortness(lengths, *totals)
        asked = {t: R.randint(1, 2) for t in R.sample(sorted(rows), 8)}
        opened = lambda: [(bm.List(rows[t], bm.weight_of(rows[t]["df"], totals[0]), *totals), r) for t, r in asked.items()]
        score = np.zeros(len(ids), np.int64)
        for x, r in opened():
            doc, tf = x.between(0, len(ids))
            score[doc] += r * bm.part(x.weight, tf, m[doc])
        want = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if s > 0)[:10]
        lists = opened()
        assert sorted((-s, i) for s, i in bm.rank_shard(lists, m, ids, window=512)) == want
        skipped += sum(len(x.last) - x.decompressed for x, _ in lists)
    assert skipped > 0


def test_empty_tables(tables):
    docs, items = tables
    assert bm.search(docs.limit(0), items).count() == 0
    assert bm.search(docs, items.limit(0)).count() == 0


def test_few_files_whatever_the_partitions(spark, tables, tmp_path, monkeypatch):
    """With one block of items only the index is written, and the result's parts follow the items."""
    written = []
    monkeypatch.setattr(common, "shared_path", lambda spark, name: written.append(name) or f"{tmp_path}/{name}-{len(written)}")
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        bm.search(*tables).write.parquet(f"{tmp_path}/out")
        assert written == ["bmm-index"]
        assert len(list((tmp_path / "out").glob("*.parquet"))) == 1
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == plain(DOCS, ITEMS)
        bm.search(*tables, item_bytes=100)
        assert written[2:] == ["bmm-found"] * len(written[2:]) and len(written) > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
