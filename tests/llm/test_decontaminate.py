"""Decontamination against a plain scan: short and repeated items, nulls, copies, shared windows, blocks, empty tables."""

import hashlib
import random
import re

import pytest

from tickerloom.llm import decontaminate as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
R = random.Random(13)
VOCAB = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "é", "7", "ß1")]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


A, B, C = prose(25), prose(12), prose(10)
ITEMS = [(1, A), (2, A), (3, B), (None, C), (10, "Only Four words HERE"), (11, "zq"), (12, None), (13, " .,! "), (14, " ".join(A.split()[5:17])), (14, B)]
TEXTS = [
    None,
    "",
    " \x00.\n",
    prose(40),
    prose(20) + " " + re.sub("[a-z]", lambda m: m[0].upper(), A) + "! " + prose(30),
    ", ".join(A.split()[3:14]) + " " + ", ".join(A.split()[2:12]) + " end",
    "x ".join(["only four WORDS here"] * 3),
    "zq ZQ zq-zq, Zq" + " " + prose(5),
    B + "\n" + C + " " + B,
    B + "\n" + C + " " + B,
    " ".join(A.split()[:9]) + " cut " + " ".join(A.split()[9:18]),
    (prose(3000) + " " + B + " ") * 4,
    "ZQÉ É" + "a",
]
ROWS = [(i if i != 6 else 5, t, "k", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "k", 1), (None, TEXTS[4], "k", 1)]


def expected(text):
    w = WORD.findall(lowered(text))
    hit, names = set(), set()
    for item, t in ITEMS:
        v = WORD.findall(lowered(t))
        k = min(10, len(v))
        if not k:
            continue
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in wins:
                hit.update(range(p, p + k))
                names.add("null" if item is None else str(item))
    return len(w), hit, names


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, key string, words int"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_plain_scan(tables):
    got = sorted((tuple(r) for r in de.contamination(*tables).collect()), key=str)
    want = []
    for i, t, *_ in ROWS:
        n, hit, names = expected(t)
        want.append((i, n, len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
    assert sum(r[-1] for r in got) >= 8


def test_blocks_of_windows_give_the_same_hits(tables):
    docs, items = tables
    known, _ = de.windows(items)
    one = sorted(map(tuple, de._hits(de.scan(docs, known)).drop("key").collect()))
    many = sorted(map(tuple, de._hits(de.scan(docs, known, block_bytes=400)).drop("key").collect()))
    assert one == many and one


def test_cleaning(tables):
    docs, items = tables
    dirty = [bool(expected(t)[1]) for _, t, *_ in ROWS]
    kept = de.remove_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(r[1]) for r, d in zip(ROWS, dirty, strict=True) if not d)
    cut = de.remove_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    by_text = sorted((str(r.doc_id), r.text) for r in cut.collect() if r.text is not None)
    want = []
    for i, t, *_ in ROWS:
        if t is None:
            continue
        _, hit, _ = expected(t)
        spots, out, at = list(WORD.finditer(lowered(t))), [], 0
        for j, m in enumerate(spots):
            if j not in hit:
                out.append(t[at : m.end()])
            at = m.end()
        want.append((str(i), "".join(out) + t[at:] if hit else t))
    assert by_text == sorted(want)


def test_empty_tables(tables):
    docs, items = tables
    assert de.contamination(docs.limit(0), items).count() == 0
    clean = de.contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(ROWS) and not any(r.contaminated for r in clean)
    assert de.remove_spans(docs, items.limit(0)).count() == len(ROWS)
