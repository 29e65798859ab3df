"""Ranked lexical search with Block-Max MaxScore over sharded postings.

Index. Tasks tokenise whole texts and cut their documents into shards of about ``SHARD_POSTINGS`` postings. A row of
the index is one term of one shard: documents holding it, occurrences, and blocks of ``BLOCK`` postings, each with its
last document, its highest number of occurrences, its shortest document, and the postings packed into as few bytes as
the block needs. What is known of a term's blocks is one run of bytes as well: most terms have one block, and five
arrays of one number in each of some 50,000 rows a shard cost the JVM more than the postings. Shards also keep their documents' lengths and ids, so the corpus counts N and L and every df are sums over index rows.

Search. Items come in blocks of bounded size, and only their terms' rows are read. Per shard and item, global
bounds (a term's weight at its best posting of the shard) order the terms; the terms whose bounds together cannot reach
the tenth score so far are non-essential. Documents of the essential lists are the candidates, taken in windows of
ascending documents so that the threshold rises on the way; for them the non-essential lists are visited from the
strongest on, and a candidate goes when its score so far, the block maximum of that list and the bounds of the weaker
lists together stay below the threshold. Only blocks that still hold a candidate are decompressed. The shards'
heaps of ten meet in one ranking per item, cut to ten per task before the shuffle.

Scores are sums of 64-bit integers; bounds use the same formula at the block's most occurrences and least length,
which no posting of the block exceeds, and only scores strictly below the threshold are given up, so ties are
decided by the id and results are exact.

Defined cases: a null or termless text is no document and never found; a null or termless item finds nothing; rows of
equal ids are documents of their own; a null id ranks behind all others of its score; items are ranked row by row,
also those of equal or null ids; an empty table gives an empty result; extra columns are not read.
"""

import heapq
import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.llm.common import BATCH_ROWS, _fields, bounded_batches, stored

TOP = 10
SHARD_POSTINGS = 1_000_000
BLOCK = 128
WINDOW = 4096  # documents of a shard that are taken at once
ITEM_BYTES = 8 << 20  # most bytes of items that are ranked in one go
LAST_ID = np.iinfo(np.int64).max  # stands for a null id

# a byte table: A-Z become small, digits, letters and bytes beyond ASCII stay, everything else ends a term
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX_SCHEMA = "shard string, term binary, df long, occurrences long, blocks binary, body binary, ids array<long>, lengths array<long>"
NAMES = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
BLOCK_FIELDS = 5  # of a block, in ``blocks``: last document, most occurrences, shortest document, widths, end of its bytes in ``body``
RESULT_ROWS = 100_000  # of a part of the result


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split() if text else []


def shortness(n, total_docs: int, total_terms: int):
    """m of documents of n terms."""
    return 25 + (75 * n * total_docs) // total_terms


def part(weight, tf, m):
    """What a term adds to a document's score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weight_of(df: int, total_docs: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def widths_of(most: np.ndarray) -> np.ndarray:
    """Bytes that numbers up to ``most`` take: 1, 2 or 4."""
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def scattered(body: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Little-endian values of 1, 2 or 4 bytes into their places of a byte array."""
    for k in range(4):
        some = slice(None) if k == 0 else width > k
        body[at[some] + k] = (value[some] >> (8 * k)) & 255


def unpacked(body: bytes, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and occurrences of a block of n postings; ``width`` holds 8 times the gaps' bytes plus the occurrences'."""
    gap, tf = divmod(width, 8)
    return np.cumsum(np.frombuffer(body, f"<u{gap}", n), dtype=np.int64), np.frombuffer(body, f"<u{tf}", n, n * gap).astype(np.int64)


class ShardWriter:
    """Collects the documents of one shard and gives its index rows."""

    def __init__(self, wanted: set[bytes] | None = None):
        self.wanted, self.vocabulary = wanted, {}
        self.term, self.distinct, self.tf, self.ids, self.lengths, self.postings = [], [], [], [], [], 0

    def add(self, key: int | None, words: list[bytes]) -> None:
        vocabulary = self.vocabulary
        self.ids.append(LAST_ID if key is None else key)
        self.lengths.append(len(words))
        counts = Counter(words)
        if self.wanted is not None:
            counts = {w: counts[w] for w in counts.keys() & self.wanted}
        self.term += [vocabulary.setdefault(w, len(vocabulary)) for w in counts]
        self.tf += counts.values()
        self.distinct.append(len(counts))
        self.postings += len(counts)

    def batch(self) -> pa.RecordBatch:
        """The shard's own row (no term), then a row per term. Blocks of all terms are packed in one go: gaps between
        documents and occurrences, each in as few bytes (1, 2, 4) as the block needs."""
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        term, tf = np.array(self.term, np.int64), np.array(self.tf, np.int64)
        doc = np.repeat(np.arange(len(ids)), self.distinct)
        order = np.argsort(term, kind="stable")
        term, doc, tf, size = term[order], doc[order], tf[order], lengths[doc[order]]
        df = np.bincount(term, minlength=len(self.vocabulary))
        first = np.concatenate([[0], np.cumsum(df)])
        blocks = -(-df // BLOCK)  # of each term
        of = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(df)), blocks)
        start = first[owner] + (np.arange(len(owner)) - of[owner]) * BLOCK
        n = np.minimum(start + BLOCK, first[owner + 1]) - start
        gap = np.diff(doc, prepend=0)
        gap[start] = doc[start]  # a block starts anew
        over = (lambda f, x: f.reduceat(x, start)) if len(start) else (lambda f, x: np.zeros(0, np.int64))
        most, least = over(np.maximum, tf), over(np.minimum, size)
        wide, narrow = widths_of(over(np.maximum, gap)), widths_of(most)
        bytes_of = n * (wide + narrow)
        offset = np.concatenate([[0], np.cumsum(bytes_of)])
        body = np.zeros(offset[-1], np.uint8)
        block = np.repeat(np.arange(len(start)), n)
        inside = np.arange(len(doc)) - start[block]
        scattered(body, offset[block] + inside * wide[block], gap, wide[block])
        scattered(body, offset[block] + n[block] * wide[block] + inside * narrow[block], tf, narrow[block])
        total = np.bincount(term, tf, len(df)).astype(np.int64)
        known = np.stack([doc[start + n - 1], most, least, wide * 8 + narrow, offset[1:] - offset[of[owner]]], axis=1).astype("<i4")

        def per_term(data, ends):
            ends = np.concatenate([[0], ends]).astype(np.int32)  # the shard's own row has none
            return pa.Array.from_buffers(pa.binary(), len(df) + 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])

        parts = [per_term(known, of * known.itemsize * BLOCK_FIELDS), per_term(body, offset[of])]
        heads = [pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(len(df) + 2), 1) * len(x), pa.int32()), pa.array(x)) for x in (ids, lengths)]
        numbers = [pa.array(np.concatenate([[h], x])) for h, x in ((len(ids), df), (int(lengths.sum()), total))]
        shard = pa.array([uuid.uuid4().hex] * (len(df) + 1))
        return pa.RecordBatch.from_arrays([shard, pa.array([None, *self.vocabulary], pa.binary()), *numbers, *parts, *heads], NAMES)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: set[bytes] | None = None, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Index rows of all documents; with ``wanted`` only the postings of those terms are written, lengths and ids always."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def out(w):
        whole = w.batch()
        for i in range(0, whole.num_rows, BATCH_ROWS):
            yield whole.slice(i, BATCH_ROWS)

    def run(batches):
        w = ShardWriter(shared.value)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if words := terms(text):
                    w.add(key, words)
                    if w.postings + len(w.ids) >= shard_postings:
                        yield from out(w)
                        w = ShardWriter(shared.value)
        if w.ids:
            yield from out(w)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, INDEX_SCHEMA)


class List:
    """One term's postings in a shard, with bounds for a corpus; blocks are decompressed when asked for."""

    def __init__(self, row, weight: int, total_docs: int, total_terms: int):
        self.weight, self.n, self.body = weight, row["df"], row["body"]
        self.last, most, least, self.widths, ends = np.frombuffer(row["blocks"], "<i4").reshape(-1, BLOCK_FIELDS).T.astype(np.int64, order="C")
        self.cut = np.concatenate([[0], ends])
        self.block_bound = part(weight, most, shortness(least, total_docs, total_terms))
        self.bound = int(self.block_bound.max())
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decompressed = 0

    def block(self, k: int):
        if k not in self.known:
            self.known[k] = unpacked(self.body[self.cut[k] : self.cut[k + 1]], int(self.widths[k]), min(BLOCK, self.n - k * BLOCK))
            self.decompressed += 1
        return self.known[k]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, occurrences) of low <= document < high."""
        a, z = int(np.searchsorted(self.last, low)), min(int(np.searchsorted(self.last, high)) + 1, len(self.last))
        if a >= z:
            return (np.zeros(0, np.int64),) * 2
        got = [self.block(k) for k in range(a, z)]
        doc, tf = (np.concatenate([g[i] for g in got]) for i in (0, 1)) if len(got) > 1 else got[0]
        i, j = np.searchsorted(doc, (low, high))
        return doc[i:j], tf[i:j]

    def occurrences(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """How often the term stands in the documents, whose blocks are given; each block is opened once."""
        out = np.zeros(len(docs), np.int64)
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(docs)], strict=True):
            doc, tf = self.block(int(block[i]))
            at = np.minimum(np.searchsorted(doc, docs[i:j]), len(doc) - 1)
            hit = doc[at] == docs[i:j]
            out[i:j][hit] = tf[at[hit]]
        return out


def rank_shard(lists: list[tuple[List, int]], m: np.ndarray, ids: np.ndarray, top: int = TOP, window: int = WINDOW) -> list[tuple[int, int]]:
    """The shard's heap of an item: its ``top`` best (score, id), ties by id. ``lists`` holds (list, repeats in the item)."""
    lists = sorted(((x, r) for x, r in lists if x.weight > 0), key=lambda p: p[0].bound * p[1])
    reach = np.cumsum([x.bound * r for x, r in lists])  # best sum of the weakest lists
    heap: list[tuple[int, int]] = []  # (score, -id), least first
    for low in range(0, len(m) if lists else 0, window):
        high = min(low + window, len(m))
        least = heap[0][0] if len(heap) == top else 1
        weak = int(np.searchsorted(reach, least))  # lists[:weak] alone stay below the threshold
        if weak == len(lists):
            break
        score, seen = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for x, r in lists[weak:]:
            doc, tf = x.between(low, high)
            score[doc - low] += r * part(x.weight, tf, m[doc])
            seen[doc - low] = True
        docs = np.flatnonzero(seen) + low
        score = score[docs - low]
        for k in range(weak - 1, -1, -1):
            if not len(docs):
                break
            x, r = lists[k]
            block = np.searchsorted(x.last, docs)
            here = block < len(x.last)
            best = np.zeros(len(docs), np.int64)
            best[here] = r * x.block_bound[block[here]]
            others = int(reach[k - 1]) if k else 0
            keep = score + best + others >= least
            docs, score, block, here = docs[keep], score[keep], block[keep], here[keep]
            if here.any():
                tf = x.occurrences(docs[here], block[here])
                score[here] += np.where(tf > 0, r * part(x.weight, tf, m[docs[here]]), 0)
        keep = score >= least
        docs, score = docs[keep], score[keep]
        if len(docs) > top:  # ties of the last place stay
            cut = np.partition(score, len(score) - top)[len(score) - top]
            docs, score = docs[score >= cut], score[score >= cut]
        for d, s in zip(docs.tolist(), score.tolist(), strict=True):
            entry = (s, -int(ids[d]))
            if len(heap) < top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return [(s, -i) for s, i in heap]


def _item_blocks(items: DataFrame, item_col: str, text_col: str, limit: int):
    """Items as (row number, id, term counts), in blocks of about ``limit`` bytes of text; one block is held at a time."""
    held, size = [], 0
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    for at, r in enumerate(rows.toLocalIterator()):
        if counts := Counter(terms(r["text"])):
            held.append((at, r["item"], counts))
            size += len(r["text"])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def search_block(index: DataFrame, items: list, kind: str, totals: tuple[int, int], top: int = TOP) -> DataFrame:
    """(row, item, doc, score): the best of each item of a block, ``top`` per shard, over stored index rows."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(bytearray(t),) for t in set().union(*[i[2] for i in items])], "term binary")
    chosen = index.join(F.broadcast(asked), "term", "left_semi")  # at most ITEM_BYTES of terms
    df = {bytes(r["term"]): r["n"] for r in chosen.groupBy("term").agg(F.sum("df").alias("n")).collect()}
    weight = {t: weight_of(n, totals[0]) for t, n in df.items()}
    shared = spark.sparkContext.broadcast((items, weight))

    def search(rows):
        items, weight = shared.value
        ids, lengths = (np.array(rows[None][k], np.int64) for k in ("ids", "lengths"))
        m = shortness(lengths, *totals)
        lists = {t: List(r, weight[t], *totals) for t, r in rows.items() if t is not None}
        for at, item, counts in items:
            mine = [(lists[t], r) for t, r in counts.items() if t in lists]
            for score, key in rank_shard(mine, m, ids, top):
                yield at, item, None if key == LAST_ID else key, score

    def run(batches):
        shard, rows = None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard:
                    if rows:
                        yield from found(search(rows))
                    shard, rows = r["shard"], {}
                rows[r["term"]] = r
        if rows:
            yield from found(search(rows))

    def found(rows):
        rows = list(rows)
        if rows:
            at, item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(item, item_type), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["row", "item", "doc", "score"])

    item_type = _fields(spark, f"item {kind}")[1][0]
    heads = index.filter(F.col("term").isNull())
    return chosen.union(heads.select(chosen.columns)).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, f"row long, item {kind}, doc long, score long")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES, **kw
) -> DataFrame:
    """(item, rank, id, score): the ``top`` best documents of every item, over all documents."""
    kind = items.schema[item_col].dataType.simpleString()
    index = stored(build_index(docs, id_col, text_col, **kw), "bmm-index", ("term", "blocks", "body"))
    heads = index.filter(F.col("term").isNull())
    total = heads.agg(F.sum("df").alias("n"), F.sum("occurrences").alias("l")).first()
    totals = (total["n"] or 0, total["l"] or 1)
    out, last, n = docs.sparkSession.createDataFrame([], f"row long, item {kind}, doc long, score long"), None, 0
    for block in _item_blocks(items, item_col, item_text_col, item_bytes):
        if last is not None:
            out = out.union(stored(last, "bmm-found"))
        last, n = search_block(index, block, kind, totals, top), n + len(block)
    if last is not None:  # ranked as it is found: with one block nothing is written between
        out = out.union(last)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    # few rows an item: parts follow the items, not the shuffle's partitions, each of which would be a file of some rows
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score").repartition(-(-n * top // RESULT_ROWS) or 1)


ORACLE = """
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), d AS (SELECT * FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (
    SELECT i, item_id, term, count(*) AS k FROM (
        SELECT row_number() OVER () AS i, item_id,
            unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM benchmark
    ) GROUP BY i, item_id, term
), s AS (
    SELECT i, item_id, r, CAST(sum(k * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
        * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), c GROUP BY i, item_id, r
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM s JOIN d USING (r) WHERE score > 0
) WHERE rank <= 10
"""
