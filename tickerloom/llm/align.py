"""Alignment of the tokens of two tokenizers by diagonal run skipping, and corpus-wide link counts.

A text is encoded by a byte-level tokenizer (A) and a subword tokenizer with a leading blank (B). Both give the byte
offsets where their tokens end. Walking both end arrays at one index shift, growing slices are compared (8, 16, 32 ...
places, then halved), so a stretch where each A token faces one B token is jumped in few comparisons. Where the arrays
differ, the group is closed at the next common end and the shift is updated. Within a group every A token links with
every B token.

Neither tokenizer joins across the start of a run of blanks that follows another character, so texts are cut there and
a worker remembers the ids of such chunks within a bound; everything else works on the whole text.

Corpus counts: the links of a document are written once as distinct pairs with their multiplicity. Pairs are counted
with map-side partial sums. At most ``FREQUENT`` pairs, the most frequent ones by quarter powers of two, are broadcast
and answered where the links lie, so no hot pair is ever shuffled; the other pairs meet their counts in a join.

Defined cases: null or empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens; special
tokens written out are plain text; rows are documents, so repeated rows count each; a null id keeps its row; an empty
table gives an empty table; extra columns are not read.
"""

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.common import bounded_batches, stored

REMEMBERED = 500_000  # chunks, pair texts and groups that a worker remembers, each
JOINED = 2000  # new chunks that a tokenizer gets in one call
PROBE = 8  # places of the first comparison of a stretch
COPIES = 4000  # whole texts whose digest a worker remembers
SPREAD = 32  # ways that rows of equal groups are dealt to meet their result
LONGEST = 48  # longer chunks are not remembered
FREQUENT = 1 << 20  # most pairs in the broadcast
EXPANDED = 4096  # larger groups are counted by their distinct ids
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*(?:\s+\Z)?")  # blanks at the very end stay with the last chunk


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow 255 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def steps(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
    """(i, i2, j, j2, single): stretches of one-to-one groups (single), and irregular groups, in order.

    Both arrays ascend and end alike. Slices are compared as bytes, 8 to a place.
    """
    raw_a, raw_b = (np.ascontiguousarray(e, "<i8").tobytes() for e in (ends_a, ends_b))
    at_a, at_b = memoryview(raw_a).cast("q"), memoryview(raw_b).cast("q")
    i, shift, n, out, first = 0, 0, len(at_a), [], 8 * PROBE
    while i < n:
        j = i + shift
        x, y = at_a[i], at_b[j]
        if x == y:
            p, q, step = 8 * i + 8, 8 * j + 8, first
            while (a := raw_a[p : p + step]) and a == raw_b[q : q + step]:
                p += len(a)
                q += len(a)
                step *= 2
            while step > 8:
                step //= 2
                if (a := raw_a[p : p + step]) and a == raw_b[q : q + step]:
                    p += len(a)
                    q += len(a)
            p //= 8
            out.append((i, p, j, q // 8, True))
            i = p
        else:
            p, q = i, j
            while x != y:
                if x < y:
                    p += 1
                    x = at_a[p]
                else:
                    q += 1
                    y = at_b[q]
            out.append((i, p + 1, j, q + 1, False))
            i = p + 1
            shift = q - p
    return out


class PairText(dict):
    """The text of a one-to-one group by its pair's number, made when first asked for."""

    def __init__(self, n_b: int):
        super().__init__()
        self.n_b = n_b

    def __missing__(self, code: int) -> str:
        text = self[code] = "%d|%d" % divmod(code, self.n_b)
        return text


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        place = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(place[c] for c in token) if all(c in place for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.n_b = len(pieces)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.bad: set[str] = set()  # chunks whose bytes a tokenizer does not give back
        self.done: dict[bytes, tuple] = {}  # digests of whole texts, for copies
        self.pair_text = PairText(self.n_b)
        self.groups: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}

    def joined(self, chunks: list[str]) -> bool:
        """Ids of chunks that follow each other in one text, cut at the chunks' ends; False if that cannot be told."""
        text = "".join(chunks)
        raw = text.encode()
        stops = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks])
        ids_a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text[1:], num_threads=1)
        parts = []
        for ids, table, sizes in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
            if b"".join([table[i] for i in ids]) != raw:
                return False
            flat = np.array(ids, "<i4")
            ends = np.cumsum(sizes[flat])
            at = np.searchsorted(ends, stops)
            if (ends[at] != stops).any():
                return False
            body, at = flat.tobytes(), (4 * (at + 1)).tolist()
            parts.append([body[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)])
        self.known.update(zip(chunks, zip(*parts, strict=True), strict=True))
        return True

    def learn(self, chunks: list[str]) -> None:
        """Chunks that end without a blank go in together, as they would in a text; what does not come back whole, alone."""
        plain = [c for c in chunks if not c[-1].isspace()]
        alone = [c for c in chunks if c[-1].isspace()]
        for i in range(0, len(plain), JOINED):
            part = plain[i : i + JOINED]
            if not self.joined(part):
                alone += part
        for c in alone:
            if not self.joined([c]):
                self.bad.add(c)
                self.known[c] = b"", b""

    def encode(self, texts: list[str | None]):
        """(ids of A, ids of B) of each text, None without tokens."""
        cut = [CHUNK.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.bad = {}, set()
        known, bad = self.known, self.bad
        new = list(set().union(*cut).difference(known))
        self.learn(new)
        for chunks in cut:
            if not chunks or (bad and not bad.isdisjoint(chunks)):
                yield None
            else:
                a, b = zip(*map(known.__getitem__, chunks), strict=True)
                yield tuple(np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (a, b))
        for c in new:
            if len(c) > LONGEST:
                known.pop(c, None)
                bad.discard(c)

    def digests(self, texts: list[str | None]) -> list[tuple]:
        """``digest`` of each text; a copy of a text that the worker still remembers is not aligned again."""
        keys = [hashlib.md5((t or "").encode()).digest() for t in texts]
        if len(self.done) > COPIES:
            self.done = {}
        fresh = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.done}
        self.done.update(zip(fresh, map(self.digest, self.encode(list(fresh.values()))), strict=True))
        return [self.done[k] for k in keys]

    def ends(self, ids) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.size_a[ids[0]]), np.cumsum(self.size_b[ids[1]])

    def digest(self, ids) -> tuple:
        """(n_a, n_b, n_groups, n_links, digest of the groups, distinct linked pairs, their multiplicities) of a text's ids."""
        if ids is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.pair_text) > REMEMBERED:
            self.pair_text.clear()
        if len(self.groups) > REMEMBERED:
            self.groups = {}
        n_b, memo, raw_a, raw_b = self.n_b, self.groups, ids[0].tobytes(), ids[1].tobytes()
        walked = steps(*self.ends(ids))
        alone = np.array([s[:3] for s in walked if s[4]], np.int64).reshape(-1, 3)
        size = alone[:, 1] - alone[:, 0]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        single = ids[0][np.repeat(alone[:, 0], size) + at] * n_b + ids[1][np.repeat(alone[:, 2], size) + at]
        named = list(map(self.pair_text.__getitem__, single.tolist()))
        texts, codes, large, n_links, done = [], [], [], len(named), 0
        for i, i2, j, j2, one_to_one in walked:
            if one_to_one:
                texts += named[done : done + i2 - i]
                done += i2 - i
                continue
            n_links += (i2 - i) * (j2 - j)
            key = raw_a[8 * i : 8 * i2], raw_b[8 * j : 8 * j2]
            if key in memo:
                text, linked = memo[key]
                texts.append(text)
                codes.append(linked)
                continue
            a, b = ids[0][i:i2], ids[1][j:j2]
            texts.append(",".join(map(str, a.tolist())) + "|" + ",".join(map(str, b.tolist())))
            if len(a) * len(b) > EXPANDED:
                (u, m), (v, k) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
                large.append((np.add.outer(u * n_b, v).ravel(), np.multiply.outer(m, k).ravel()))
            else:
                codes.append(np.add.outer(a * n_b, b).tobytes())
                memo[key] = texts[-1], codes[-1]
        pairs, times = np.unique(np.concatenate([single, np.frombuffer(b"".join(codes), np.int64)]), return_counts=True)
        for p, t in large:
            both, at = np.unique(np.concatenate([pairs, p]), return_inverse=True)
            pairs, times = both, np.bincount(at, np.concatenate([times, t])).astype(np.int64)
        return len(ids[0]), len(ids[1]), len(texts), n_links, hashlib.sha256(";".join(texts).encode()).hexdigest(), pairs, times


_aligners: dict = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """Built once per Python worker."""
    key = (byte_path, piece_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def alignment(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, a_ends, b_ends): both id lists and, per group, the token counts up to its end in each."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        t = aligner(byte_path, piece_path)
        for batch in batches:
            cols = [[], [], [], []]
            for ids in t.encode(batch.column(1).to_pylist()):
                ids = ids or (np.zeros(0, np.int64),) * 2
                ends = [[], []]
                for i, i2, j, j2, single in steps(*t.ends(ids)):
                    ends[0] += range(i + 1, i2 + 1) if single else [i2]
                    ends[1] += range(j + 1, j2 + 1) if single else [j2]
                for c, v in zip(cols, [*ids, *(np.array(e, np.int64) for e in ends)], strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[_lists(c, pa.int32()) for c in cols]], [id_col, "a", "b", "a_ends", "b_ends"])

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


def piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def linked_pairs(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its counts, the digest of its groups, its distinct linked pairs (a * size of B + b) and their multiplicities."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        t = aligner(byte_path, piece_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 250):
                got = list(zip(*t.digests(texts[at : at + 250]), strict=True))
                numbers = [pa.array(c, pa.int64()) for c in got[:4]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 250), *numbers, pa.array(got[4]), _lists(got[5], pa.int64()), _lists(got[6], pa.int64())], names
                )

    bounded_batches(docs.sparkSession)
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether that is the most for its A id."""
    n = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    a = F.floor(F.col("pair") / n_b)
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row per id of A's vocabulary at most
    return n.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_cut(counts: DataFrame, limit: int) -> int:
    """The least quarter power of two such that at most ``limit`` pairs count that much."""
    level = F.floor(F.log2("n") * 4).cast("int").alias("level")
    rows = sorted(((r["level"], r["m"]) for r in counts.groupBy(level).agg(F.count("*").alias("m")).collect()), reverse=True)  # 250 rows at most
    cut, total = 256, 0
    for lvl, m in rows:
        total += m
        if total > limit:
            break
        cut = lvl
    return cut


def link_statistics(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = docs.sparkSession
    rows = stored(linked_pairs(docs, byte_path, piece_path, id_col, text_col), "align-rows")
    kind = rows.schema["id"].dataType.simpleString()
    counts = stored(pair_counts(rows, piece_count(piece_path)), "align-best")
    level = F.floor(F.log2("n") * 4)
    top = counts.filter(level >= frequent_cut(counts, frequent)).toArrow()  # ``frequent`` rows at most
    order = np.argsort(top["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy()[order], top["n"].to_numpy()[order], top["best"].to_numpy()[order]))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look_up(batches):
        pairs, n, best = shared.value
        for b in batches:
            flat, times = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (6, 7))
            size = np.diff(b.column(6).offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            hit = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            total, most = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(total, row[hit], n[at[hit]] * times[hit])
            np.add.at(most, row[hit], best[at[hit]] * times[hit])
            rest = np.bincount(row[~hit], minlength=len(size))
            ends = pa.array(np.concatenate([[0], np.cumsum(rest)]).astype(np.int32))
            left = [pa.ListArray.from_arrays(ends, pa.array(v[~hit])) for v in (flat, times)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(most), pa.array(total), *left], [*names, "n_best", "count_sum", "pairs", "times"])

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"
    part = stored(rows.select(*names, "pairs", "times").mapInArrow(look_up, schema), "align-part")
    rest = part.filter(F.size("pairs") > 0).select("groups_sha256", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("groups_sha256", "p.pairs", "p.times")
    found = rest.distinct().join(counts, F.col("pairs") == F.col("pair"))  # texts of equal groups have equal links
    # rows of equal texts share one result, which is repeated so that they spread
    more = found.groupBy("groups_sha256").agg(F.sum(F.col("n") * F.col("times")).alias("_total"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_most"))
    more = more.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    zero = F.lit(0).cast("long")
    return part.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).join(more, ["groups_sha256", "_salt"], "left").select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("_most", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_total", zero)).alias("count_sum"),
        "groups_sha256",
    )
