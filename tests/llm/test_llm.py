"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import jaccard, lattice, lbl, mixing, omh, orc_tokens, pii, piece, toxicity, warc
from tickerloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key long, hash string"
R = random.Random(4)
VOCAB = ["".join(R.choice("abcdeé") for _ in range(R.randint(1, 6))) for _ in range(120)]
prose = lambda n: " ".join(R.choice(VOCAB) for _ in range(n))
LONG = prose(9000)
TEXTS = [None, "", " \n\t", "One two", "one  TWO", "a", LONG, LONG, LONG + " tail", "mail me@x.example.com now", *[prose(R.randint(3, 90)) for _ in range(30)]]
EDITED = TEXTS[12] + " and one more"
ROWS = [(i, t, "en", [None, "s0", "s1", "s2"][i % 4], len(t or ""), "x", 1, "y") for i, t in enumerate([*TEXTS, EDITED, TEXTS[12]])]
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints(docs, none):
    got = by_id(omh.fingerprints(docs))
    for i, text in TEXT.items():
        before = TEXT[i - 1 if i else len(TEXT) - 1]
        third = len(text) // 3
        edited = text[: len(text) - third] + before[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == sha(edited)
        assert got[i].fingerprint == omh.hexed(omh.signature(text)) and got[i].near_next == omh.likeness(omh.signature(text), omh.signature(before))
    assert got[6].fingerprint == got[7].fingerprint and got[6].near_next < 1
    assert omh.fingerprints(none).count() == 0


def test_fingerprints_follow_order():
    a, b = prose(300), prose(300)
    assert omh.likeness(omh.signature(a + " " + b), omh.signature(b + " " + a)) < omh.likeness(omh.signature(a + " " + b), omh.signature(a + " " + b + " x"))


def test_archive(spark):
    pages = [(1, "u", "x"), (2, None, "x"), (3, "v", None), (4, "v", ""), (5, "w", LONG * 3), (6, "w", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "w", "other"), (None, "z", "x")]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), segment=5000).collect()
    assert len(got) == len(pages) and all(r.fault is None for r in got)
    want = Counter((p, len((h or "").encode()), warc.digest((h or "").encode())) for p, _, h in pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert kinds[1, 1] == ("revisit", 2) and kinds[2, 1] == ("response", None) and kinds[3, 0] == ("revisit", 4) and kinds[None, 1] == ("revisit", 2)


def test_broken_segments_are_told(spark):
    rows = [("response", "<urn:page:1#0.0>", None, 1, None, None, "sha1:X", None, b"abc"), ("continuation", "c", "<urn:page:1#0.0>", 3, 9, None, None, None, b"def")]
    schema = "kind string, name string, origin string, segment int, total long, refers string, digest string, length long, block binary"
    assert warc.payload_rows(warc.reassemble(spark.createDataFrame(rows, schema))).first().fault == "a segment is missing or repeated"


def test_scores(docs, none):
    got = by_id(lbl.score_documents(docs))
    words = {i: t.encode().lower().split() for i, t in TEXT.items()}
    train = [i for i in TEXT if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, w in words.items():
        base = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base)) and got[i].n_tokens == len(w) + 1 and got[i].train_tokens == n
        assert got[i].n_known == sum(x in c for x in w) + 1 and got[i].score < 0
    assert lbl.score_documents(none).count() == 0


def test_model_is_normalised():
    units = lbl.Units([b"a", b"b"])
    p = lbl.start(units, np.full(units.n, 1 / units.n))
    t = lbl.tables({k: v + np.random.default_rng(1).standard_normal(v.shape).astype(np.float32) * 0.3 for k, v in p.items()})
    assert np.exp(t["one"][:, None, :] + t["two"][None, :, :] - t["norm"][:, :, None]).sum(2) == pytest.approx(1, abs=1e-3)


def test_personal_data(docs, none):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def brute(text):
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m.group())
                bad = {"ip": lambda m=m: any(int(x) > 255 for x in m.group().split(".")), "card": lambda d=d: not (16 <= len(d) <= 19 and pii.luhn(d)), "phone": lambda d=d: not 8 <= len(d) <= 15}
                if not bad.get(kind, lambda: False)():
                    yield kind, m.start(), m.end()

    for alphabet in ("01.@+ -a()%", "4 -.1", "a@.b", "+12 ().-"):
        for _ in range(400):
            text = "".join(R.choice(alphabet) for _ in range(R.randrange(70)))
            assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == list(brute(text))
    assert by_id(pii.detect(docs))[9].spans == "email:5:21" and pii.detect(none).count() == 0
    out = by_id(pii.masked(docs))
    assert out[9].text == "mail <EMAIL> now" and out[9].n_chars == 16 and out[0].text is None and out[9].label == "x"


def test_toxicity_learns_and_filters(spark, none):
    rows = [(i, prose(40) + (" blorgish " if i % 4 == 0 else " ") + prose(R.randint(0, 80)), i % 4 == 0) for i in range(320)] + [(400, None, False), (401, "", False)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = by_id(toxicity.score(docs, model))
    held = [(got[i].score >= 0.7, y) for i, t, y in rows if t and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in toxicity.clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.filter("toxic = 2"))).agg(F.max("score")).first()[0] == 0.0


def test_pieces_equal_the_library(docs, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = piece.piece_table(path)
    odd = ["".join(R.choice("ab  th▁e\n\tinr<0x>é日😀\x00") for _ in range(R.randrange(50))) for _ in range(500)]
    for text in [*TEXT.values(), *odd, "a" * 3000, " " * 500]:
        ids = sp.encode(text, add_eos=True)
        n, joined, decoded = table.digest(text)
        assert joined == " ".join(map(str, ids)) and n == len(ids) and decoded == sp.decode(ids) == table.decode(table.encode(text))
    got = by_id(piece.round_trip(docs, path))
    assert got[0].n_tokens == got[1].n_tokens == 1 and got[6].decoded_sha256 == sha(LONG) and piece.round_trip(none, path).count() == 0
    tokens = piece.encode_documents(docs, path)
    assert by_id(piece.decode_documents(tokens, path))[6].text == LONG


def test_mix(docs, none):
    rows = mixing.mix(docs).collect()
    sources = {}
    for r in rows:
        s = sources.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.taken
        s[3] = max(s[3], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert sum(s[1] for s in sources.values()) == pytest.approx(1.5 * sum(s[0] for s in sources.values()))
    for size, target, taken, largest in sources.values():
        assert target <= 2 * size + 1e-6 and 0 <= target - taken <= largest
    again = Counter(r.doc_id for r in mixing.apply_mix(docs).collect())
    assert again == Counter({r.doc_id: r.n_taken for r in rows if r.n_taken})
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).columns == none.columns


def test_jaccard(docs, none):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in TEXT.items()}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    got = by_id(jaccard.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), root[i]) for i, s in sets.items()}
    assert root[8] == 6 and root[4] == 3 and len(set(root.values())) < len(root)
    assert {r.doc_id for r in jaccard.representatives(docs).collect()} == set(root.values())
    assert jaccard.near_duplicates(none).count() == 0


def test_signature_tree_is_exact():
    r = np.random.default_rng(2)
    base = [np.unique(r.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)) for _ in range(40)]
    sets = [*base, *[np.unique(np.concatenate([b[k:], r.integers(0, 2**63, k).astype(np.uint64)])) for b in base for k in (2, 6, 8, 9, 12, 30)]]
    forest = jaccard.SignatureTree(sets).links()
    brute = jaccard.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.enough(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j]))):
                brute.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [brute.root(i) for i in range(len(sets))]


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    start, got = 0, by_id(orc_tokens.round_trip(docs, path))
    for i, text in TEXT.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert orc_tokens.round_trip(none, path).count() == 0
    whole, cut = orc_tokens.Encoder(path, 2, False), orc_tokens.Encoder(path, 2, True)
    odd = ["".join(R.choice("aAéİΣσ .,!'st1²́ \n-_|@日") for _ in range(R.randrange(30))) for _ in range(1500)]
    assert whole.encode(odd) == cut.encode(odd)


def test_lattice(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 64))
    y = x[:150] + r.standard_normal((150, 64)) * 0.44
    v = [*x.tolist(), *y.tolist(), x[0].tolist(), None, [0.0] * 64, [float("nan")] * 64, [None] * 64, []]
    schema = "vec_id long, embedding array<double>, label int"
    got = by_id(lattice.near_duplicates(spark.createDataFrame([(i, e, 0) for i, e in enumerate(v)], schema)), "vec_id")
    u = np.array(v[:451])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(451)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum() > 100
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(451, 456))
    assert got[450].component_id == 0 and not got[450].kept
    assert lattice.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_e8_decoder_finds_a_nearest_point():
    r = np.random.default_rng(1)
    x = r.standard_normal((200, 8)) * 2
    c = lattice.nearest_e8(x)
    d = ((x - c) ** 2).sum(1)
    assert len(lattice.shortest_vectors()) == 240
    assert all((((x - c - root) ** 2).sum(1) >= d - 1e-9).all() for root in lattice.shortest_vectors())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "tokens":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toArrow())
    assert docs.count() > 0 and docs.filter("NOT same_text").count() == 0


def test_unlike_vectors_with_like_sketches_make_no_bundle(spark, monkeypatch):
    """Sketches of few bits agree for many unlike pairs: verified, such pairs join nothing, and no table goes to the driver."""
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 16))
    v = [*x.tolist(), *(x[:40] + r.standard_normal((40, 16)) * 0.1).tolist()]
    kept, plans, stored = {}, {}, lattice.stored

    def watched(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        kept[name] = stored(df, name, *rest)
        return kept[name]

    monkeypatch.setattr(lattice, "stored", watched)
    monkeypatch.setattr(lattice, "SENT", "-1", raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    got = by_id(lattice.near_duplicates(spark.createDataFrame([(i, e) for i, e in enumerate(v)], "vec_id long, embedding array<double>")), "vec_id")
    u = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(440)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum() > 70
    assert kept["lat-bundles"].groupBy("bundle").count().agg({"count": "max"}).first()[0] <= 8
    assert not any("Broadcast" in p for p in plans.values())
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
