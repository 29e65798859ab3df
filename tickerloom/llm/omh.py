"""Order MinHash fingerprints of documents.

The k-mers of a text are numbered by occurrence (the second "abc..." differs from the first), each numbered
k-mer gets a hash, and sketch s keeps the LENGTH of them that are least under the s-th hash. Kept k-mers are put
back into text order and hashed as a tuple, so a component of the signature is equal in two texts only if
they share these k-mers in this order: the share of equal components follows edit distance, not only overlap.

Numbering sorts (k-mer hash, place) as one 64-bit word: the hash keeps 64 minus the bits of a place, ample for
the k-mers of one text. Multiplying by an odd constant gives each sketch its order.

Defined cases: a null text counts as empty; a text of fewer than k code points is its own single k-mer; the empty
text has a signature of its own, equal only to itself; equal texts have equal fingerprints; an empty table gives
an empty table; the only document follows itself.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.llm.common import bounded_batches, map_rows, stored

K, LENGTH, SKETCHES = 8, 2, 24
RANGE_CHARS = 8_000_000
MULTIPLIERS = np.random.default_rng(11).integers(0, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_a, _b, _c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h):
    h = (h ^ (h >> np.uint64(30))) * _b
    h = (h ^ (h >> np.uint64(27))) * _c
    return h ^ (h >> np.uint64(31))


def kmers(text: str, k: int = K) -> np.ndarray:
    """Hash of the k code points at each place; k is a power of two."""
    h = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(h) < k:
        return mixed(np.array([len(h) + 1], np.uint64) * _a + np.uint64(int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little")))
    step, factor = 1, int(_a)
    while step < k:
        h = h[: len(h) - step] * np.uint64(factor) + h[step:]
        factor, step = (factor * factor + 2) % 2**64, step * 2
    return mixed(h)


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of occurrence-numbered k-mers, and their places."""
    n = len(h)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    s = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
    key, place = s >> bits, (s & low).astype(np.int64)
    index = np.arange(n)
    first = np.where(np.concatenate([[True], key[1:] != key[:-1]]), index, 0)
    occurrence = (index - np.maximum.accumulate(first)).astype(np.uint64)
    return mixed(h[place] + occurrence * _a), place


def signature(text: str | None, k: int = K, length: int = LENGTH, sketches: int = SKETCHES) -> np.ndarray:
    """``sketches`` 32-bit components."""
    if not text:
        return np.zeros(sketches, np.uint32)
    h, place = numbered(kmers(text, k))
    length = min(length, len(h))
    got = np.empty((sketches, length), np.int64)
    top = np.uint64(2**64 - 1)
    buffer = np.empty_like(h)
    for s in range(sketches):
        np.multiply(h, MULTIPLIERS[s], out=buffer)
        for i in range(length):
            got[s, i] = at = buffer.argmin()
            buffer[at] = top
    order = np.argsort(place[got], axis=1, kind="stable")
    kept = h[np.take_along_axis(got, order, 1)]
    out = np.full(sketches, np.uint64(length))
    for i in range(length):
        out = mixed(out * _a + kept[:, i])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexed(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third replaced by the first as many code points of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


def with_neighbour(docs: DataFrame) -> DataFrame:
    """(range, guest, id, tie, text), to be read in this order: before each row stands the one that follows it in descending id.

    Ids are cut at approximate quantiles into ranges, so neighbours meet in one task without a global sort. The
    last row of each range goes once more, as a guest, ahead of the next range, and the greatest ahead of the first.
    """
    docs = docs.withColumn("tie", F.xxhash64("text"))
    chars = docs.agg(F.sum(F.char_length("text")).alias("c"), F.count("*").alias("n")).first()
    n = max(1, min(4096, chars["n"] or 1, -(-(chars["c"] or 0) // RANGE_CHARS)))
    cuts = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts)) if n > 1 else []
    place = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0)) if len(cuts) <= 16 else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("id")))
    ids = stored(docs.select("id", "tie", place.cast("int").alias("range")), "omh-ids")
    # one row per range: its greatest row, and the range that row goes to as a guest
    greatest = ids.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("m"))
    order = Window.partitionBy().orderBy("range")
    to = F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy()))
    guests = [(r["range"], r["to"], r["m"]["id"], r["m"]["tie"]) for r in greatest.select("range", to.alias("to"), "m").collect()]
    table = docs.sparkSession.createDataFrame(guests or [(None, None, None, None)], "_r int, _to int, _id long, _tie long")
    rows = docs.withColumn("range", place.cast("int"))
    hit = rows.join(F.broadcast(table), (F.col("range") == F.col("_r")) & F.col("id").eqNullSafe(F.col("_id")) & F.col("tie").eqNullSafe(F.col("_tie")), "left")
    both = hit.withColumn("guest", F.explode(F.when(F.col("_to").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return (
        both.select(F.when(F.col("guest"), F.col("_to")).otherwise(F.col("range")).alias("range"), "guest", "id", "tie", "text")
        .repartition("range")
        .sortWithinPartitions("range", F.col("guest").desc(), F.col("id").asc_nulls_first(), "tie", "text")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, length: int = LENGTH, sketches: int = SKETCHES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    bounded_batches(docs.sparkSession)
    near = with_neighbour(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    last: list = [None, None]  # text and signature of the row before

    def rows(cols):
        for _, guest, key, _, text in zip(*cols, strict=True):
            text = text or ""
            sig = signature(text, k, length, sketches)
            if not guest:
                following, its = last if last[0] is not None else (text, sig)
                changed = edited(text, following)
                other = sig if changed == text else signature(changed, k, length, sketches)
                sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
                yield key, len(text), sha, hexed(sig), hexed(other), likeness(sig, other), likeness(sig, its)
            last[:] = [text, sig]

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(near, schema, rows)
