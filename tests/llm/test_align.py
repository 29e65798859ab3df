"""Alignment against a plain set of common ends; link counts against a plain count over all documents."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickerloom.llm import align
from tickerloom.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
R = random.Random(12)
ODD = "aZé ñ'’.,-_<>|\n\t\r\x0b\x1c  ▁😀漢字́\x00 0123 "
TEXTS = [
    None,
    "",
    " ",
    "   ",
    "word",
    " lead and  double   blanks ",
    "a\n b\n\n  c \t d",
    "literal <|endoftext|> and </s> <0x41> <unk>",
    "the mark ▁ is a blank here",
    "nul \x00 byte",
    "😀😀 漢字かな é é",
    "Ωmega " * 3000,
    "x" * 20_000,
    "dup text, twice",
    "dup text, twice",
    "isn't it's WE'LL don't 12345 3.14",
    *["".join(R.choice(ODD) for _ in range(R.randint(1, 60))) for _ in range(60)],
    *[" ".join(R.choice(["the", "of", "alignment", "tokeniser", "Überraschung", "x1", "--", "..."]) for _ in range(R.randint(1, 200))) for _ in range(20)],
]
ROWS = [(i, t, "k", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], "k", 1), (4, TEXTS[15], "k", 1)]


def plain(text):
    """Groups of a text by the libraries over the whole text and a set of common ends."""
    if not text:
        return []
    al = align.aligner(*PATHS)
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(al.bytes_a[i] for i in a) != raw or b"".join(al.bytes_b[i] for i in b) != raw:
        return []
    ends = []
    for ids, sizes in ((a, al.bytes_a), (b, al.bytes_b)):
        at, e = 0, []
        for i in ids:
            at += len(sizes[i])
            e.append(at)
        ends.append(e)
    both = set(ends[0]) & set(ends[1])
    groups, cur = [], ([], [])
    by_end = sorted([(e, 0, i) for e, i in zip(ends[0], a, strict=True)] + [(e, 1, i) for e, i in zip(ends[1], b, strict=True)])
    for k, (e, side, i) in enumerate(by_end):
        cur[side].append(i)
        if e in both and (k + 1 == len(by_end) or by_end[k + 1][0] != e):
            groups.append(cur)
            cur = ([], [])
    return groups


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, pairs string, id int")


def expected():
    groups = [plain(t) for _, t, *_ in ROWS]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count, most = Counter(), defaultdict(int)
    for c in linked:
        count.update(c.keys())
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, *_), g, c in zip(ROWS, groups, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (
                i,
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                sum(c.values()),
                sum(n for p, n in c.items() if count[p] == most[p[0]]),
                sum(n * count[p] for p, n in c.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )
        )
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [align.FREQUENT, 20, 0])
def test_against_plain_counts(docs, frequent):
    got = align.link_statistics(docs, *PATHS, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected()


def test_group_ends(docs):
    for r in align.alignment(docs.filter("doc_id < 30"), *PATHS).collect():
        groups = [(r.a[i:p], r.b[j:q]) for i, p, j, q in zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends, strict=False)]
        assert groups in ([(list(a), list(b)) for a, b in plain(t)] for i, t, *_ in ROWS if i == r.doc_id)


def test_steps():
    for _ in range(300):
        total = R.randint(1, 80)
        a, b = (sorted({*R.sample(range(1, total + 1), R.randint(1, total)), total}) for _ in range(2))
        got, want = [], sorted(set(a) & set(b))
        i0 = j0 = 0
        for i, i2, j, j2, single in align.steps(np.array(a), np.array(b)):
            assert (i, j) == (i0, j0)
            i0, j0 = i2, j2
            got += a[i:i2] if single else [a[i2 - 1]]
            assert a[i2 - 1] == b[j2 - 1] and (not single or a[i:i2] == b[j:j2])
        assert got == want and (i0, j0) == (len(a), len(b))


def test_large_groups_count_by_distinct_ids(monkeypatch):
    t = align.Aligner(*PATHS)
    ids = next(t.encode(["Überraschung Ωmega " * 20]))
    whole = t.digest(ids)
    monkeypatch.setattr(align, "EXPANDED", 0)
    for x, y in zip(whole, t.digest(ids), strict=True):
        assert (x == y) if not hasattr(x, "tolist") else x.tolist() == y.tolist()


def test_empty_table(docs):
    assert align.link_statistics(docs.limit(0), *PATHS).count() == 0
