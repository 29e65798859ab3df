"""Token ids as ORC files: ascending ids of documents, run-length encoded integers, row indexes, Bloom filters.

Documents are cut into ranges of their ids and sorted inside each (no global sort, no group); a range is
encoded by one task and becomes one file, or several where the session limits a file's rows. Spark's ORC writer keeps the ids as run-length encoded integers in stripes,
a row index every ``stride`` rows and a Bloom filter on the id, so readers take stripes in parallel and skip by
metadata. A row also holds its task's number and how many ids the task has before it, so a document's global start is
that plus the sizes of the tasks before its own: one number per task.

Equal words have equal ids: a worker remembers words between blanks within a bound and gives only new ones to
the tokenizer. That is exact for tokenizers that lower the case and whose pieces span neither a blank nor the
place between a letter or digit and a mark (with ``chunks`` false every text goes to the tokenizer whole).
Added tokens, such as the end of a text written out, get their own ids as in the library; a word that holds one
in any case goes to the tokenizer alone and as it is.

Defined cases: a null or empty text has the end id only; rows of equal ids stand together, ordered by text;
rows without an id come first; an empty table gives an empty table; extra columns are not written.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickerloom.llm.common import bounded_batches, shared_path, stored

REMEMBERED = 900_000
STRIDE, FPP = 1000, 0.01
DOTTED_I = "\u0130"  # the one letter whose small form ends in a mark
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe: a run of them is one unit


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str, end_id: int, chunks: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.chunks, self.known = np.int32(end_id).tobytes(), chunks, {"": b""}
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in self.added for c in t):
            self.chunks = False  # such a token spans words
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, words: list[str]) -> set[str]:
        """Words that hold an added token, in any case."""
        joined = "\n".join(words).lower()
        found = [t for t in self.added if t in joined]
        return {w for w in words if any(t in w.lower() for t in found)} if found else set()

    def word_ids(self, part: list[str], apart: set[str]) -> list[bytes]:
        """Ids of words, many to a call. A word of letters is one unit of the tokenizer and ends with the only id
        of its own that has the end-of-word suffix; other words go in one by one."""
        plain = [w for w in part if w.isalpha() and DOTTED_I not in w and w not in apart]
        got = {}
        if self.ends is not None and len(plain) > 1:
            flat = np.frombuffer(self.ids([" ".join(plain)])[0], "<i4")
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) == len(plain):
                raw, stops = flat.tobytes(), (4 * ends).tolist()
                got = {w: raw[a:b] for w, a, b in zip(plain, [0, *stops[:-1]], stops, strict=True)}
        rest = [w for w in part if w not in got]
        got.update(zip(rest, self.ids(rest), strict=True))
        return [got[w] for w in part]

    def learn(self, new: list[str]) -> None:
        """A word of letters or digits and closing marks is the word and the marks; Latin capitals are their small letters."""
        known, stems, tails, apart = self.known, [], [], self.apart(new)
        for w in new:
            if w in apart:
                stems.append(w)
                tails.append("")
                continue
            stem = w.rstrip(MARKS)
            if not stem.isalnum() or stem[-1] == DOTTED_I:
                stem = w
            stems.append(stem.lower() if stem.isascii() or max(stem) < "\u0100" else stem)
            tails.append(w[len(stem) :])
        ask = [w for w in dict.fromkeys([*stems, *tails]) if w and w not in known]
        for i in range(0, len(ask), 1000):
            known.update(zip(ask[i : i + 1000], self.word_ids(ask[i : i + 1000], apart), strict=True))
        for w, stem, tail in zip(new, stems, tails, strict=True):
            known[w] = known[stem] + known[tail] if tail else known[stem]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.chunks:
            return [b + self.end for b in self.ids([t or "" for t in texts])]
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        known = self.known
        if new := list(set().union(*cut).difference(known)):
            self.learn(new)
        return [b"".join(map(known.__getitem__, c)) + self.end for c in cut]


_encoders: dict = {}


def encoder(path: str, end_id: int, chunks: bool) -> Encoder:
    """Built once per Python worker."""
    key = (path, end_id, chunks)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", chunks: bool = True, stride: int = STRIDE) -> None:
    """ORC files, a range of ids each, under ``out``: (doc_id, before, ids, task)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        e, before, task = encoder(path, end_id, chunks), 0, TaskContext.get().partitionId()  # ranges ascend with it
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 200):
                got = e.encode(texts[at : at + 200])
                size = np.array([len(g) // 4 for g in got], np.int64)
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(got))])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
                tasks = pa.array(np.full(len(got), task, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 200), pa.array(before + ends[:-1]), ids, tasks], ["doc_id", "before", "ids", "task"])
                before += int(ends[-1])

    sorted_docs = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    (
        sorted_docs.mapInArrow(run, f"doc_id {kind}, before long, ids array<int>, task int")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(FPP))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("compression", "lz4")
        .orc(out)
    )


def read_rows(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, before, ids, task): filters on doc_id reach the stripes."""
    return spark.read.orc(out).select("doc_id", "before", "ids", "task")


def token_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids read. The ids stay in their task; only numbers meet the tasks' sums."""

    def run(batches):
        for b in batches:
            ids = b.column(2)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "before", "task", "n_tokens", "ids_crc32"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = stored(tokens.mapInArrow(run, f"doc_id {kind}, before long, task int, n_tokens long, ids_crc32 long"), "orc-digest")
    size = rows.groupBy("task").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    earlier = Window.partitionBy().orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    base = size.select(F.col("task").alias("_task"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(base, F.col("task") == F.col("_task")).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write, read back, and digest what was read."""
    out = shared_path(docs.sparkSession, "tokens-orc")
    write_tokens(docs, out, path, end_id, id_col, text_col)
    return token_digest(read_rows(docs.sparkSession, out)).withColumnRenamed("doc_id", id_col)
