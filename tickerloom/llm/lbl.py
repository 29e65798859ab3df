"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Units: the TOP most frequent words, the end of a text, and CLASSES classes that all other words fall into by
their last letters. A word of a class has its smoothed share of the class, so every word, known or not, has a
probability. The model predicts the next unit from the two before it: the sum of their vectors, weighted by
position, times the vector of the unit, plus its bias. Scores add up over the two positions, so the
normaliser of every pair of context units is one matrix product, exp(first) @ exp(second): token
log-probabilities are normalised exactly, over all units.

Training: every task runs minibatches of noise-contrastive estimation over all of its training texts, from a
common start with unigram biases; the models, of a fixed size, are averaged in two steps by numbers of tokens. One pass
over all training texts, no sample.

Counts: tasks pre-aggregate words, the shuffle sums them. Scoring: texts are dealt to blocks; the distinct
words of a block meet their counts in one join and return to the block, so neither the vocabulary nor
a (document, word) table is ever gathered or broadcast.

Defined cases: a null or empty text is one end; with no training text all counts are 0 and
V = 0; a repeated id is scored row by row; ties for the last unit are broken by the word; an empty
table gives an empty table; extra columns are not read.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.common import bounded_batches, held_out, stored, words

TOP, CLASSES, DIM = 896, 126, 16
BATCH, NOISE = 4096, 32
BLOCK_CHARS = 8_000_000
GROUPS = 16


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


class Units:
    """Words to units: 0 the start, 1 the end, then the frequent words, then the classes."""

    def __init__(self, top: list[bytes]):
        self.top = {w: i + 2 for i, w in enumerate(top)}
        self.n = 2 + len(top) + CLASSES
        self.base = 2 + len(top)

    def of(self, word: bytes) -> int:
        u = self.top.get(word)
        return self.base + class_of(word) if u is None else u


class Seen(dict):
    def __init__(self, units: Units):
        super().__init__()
        self.units = units

    def __missing__(self, w):
        u = self[w] = self.units.of(w)
        return u


def start(units: Units, unigram: np.ndarray) -> dict[str, np.ndarray]:
    r = np.random.default_rng(5)
    return {
        "q": (r.standard_normal((units.n, DIM)) * 0.3).astype(np.float32),
        "r": (r.standard_normal((units.n, DIM)) * 0.05).astype(np.float32),
        "c": np.array([[0.7] * DIM, [0.3] * DIM], np.float32),
        "b": np.log(unigram).astype(np.float32),
    }


class Trainer:
    """Adagrad steps of noise-contrastive estimation with noise shared by a minibatch."""

    def __init__(self, p: dict, unigram: np.ndarray, rate: float = 0.2):
        self.p = {k: v.copy() for k, v in p.items()}
        self.sq = {k: np.full(v.shape, 1e-6, np.float32) for k, v in p.items()}
        self.noise_log = np.log(NOISE * unigram).astype(np.float32)
        self.cum = np.cumsum(unigram)
        self.cum /= self.cum[-1]
        self.random, self.rate, self.tokens = np.random.default_rng(9), rate, 0
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, units: np.ndarray) -> None:
        """Contexts and targets of one text: two starts before it."""
        u = np.concatenate([[0, 0], units])
        self.held.append(np.stack([u[1:-1], u[:-2], u[2:]]))
        self.size += len(units)
        if self.size >= 64 * BATCH:
            self.flush()

    def flush(self) -> None:
        if self.held:
            x = np.concatenate(self.held, 1)
            x = x[:, self.random.permutation(x.shape[1])]
            for i in range(0, x.shape[1], BATCH):
                self.step(*x[:, i : i + BATCH])
            self.held, self.size = [], 0

    def step(self, u1, u2, w) -> None:
        p, m = self.p, len(w)
        self.tokens += m
        noise = np.searchsorted(self.cum, self.random.random(NOISE)).clip(0, len(self.cum) - 1)
        q1, q2 = p["q"][u1], p["q"][u2]
        q = p["c"][0] * q1 + p["c"][1] * q2
        rw, rn = p["r"][w], p["r"][noise]
        g = 1 / (1 + np.exp(-np.clip((q * rw).sum(1) + p["b"][w] - self.noise_log[w], -20, 20))) - 1
        h = 1 / (1 + np.exp(-np.clip(q @ rn.T + p["b"][noise] - self.noise_log[noise], -20, 20)))
        dq = g[:, None] * rw + h @ rn
        grad = {"c": np.stack([(dq * q1).sum(0), (dq * q2).sum(0)])}
        grad["q"] = scattered(np.concatenate([u1, u2]), np.concatenate([dq * p["c"][0], dq * p["c"][1]]), p["q"].shape)
        grad["r"] = scattered(np.concatenate([w, noise]), np.concatenate([g[:, None] * q, h.T @ q]), p["r"].shape)
        grad["b"] = np.bincount(w, g, len(p["b"])) + np.bincount(noise, h.sum(0), len(p["b"]))
        for k, d in grad.items():
            d = (d / m).astype(np.float32)
            self.sq[k] += d * d
            p[k] -= self.rate * (0.2 if k == "b" else 1) * d / np.sqrt(self.sq[k] + 1e-8)


def scattered(rows: np.ndarray, values: np.ndarray, shape) -> np.ndarray:
    """Sums of values by row."""
    flat = (rows[:, None] * shape[1] + np.arange(shape[1])).ravel()
    return np.bincount(flat, values.ravel(), shape[0] * shape[1]).reshape(shape)


def tables(p: dict) -> dict[str, np.ndarray]:
    """Scores of a unit after each context unit, and the normaliser of each pair of context units, by matrix products."""
    one = (p["q"] * p["c"][0]) @ p["r"].T + p["b"]
    two = (p["q"] * p["c"][1]) @ p["r"].T
    one[:, 0] = -1e4  # the start is never predicted
    a, b = one.max(1, keepdims=True), two.max(1, keepdims=True)
    z = np.exp((one - a).astype(np.float64)) @ np.exp((two - b).astype(np.float64)).T
    return {"one": one.astype(np.float32), "two": two.astype(np.float32), "norm": (np.log(z) + a + b.T).astype(np.float32)}


def unit_score(t: dict, units: np.ndarray) -> float:
    """Natural log probability of the units of one text, end included."""
    u = np.concatenate([[0, 0], units])
    u1, u2, w = u[1:-1], u[:-2], u[2:]
    return float((t["one"][u1, w] + t["two"][u2, w] - t["norm"][u1, u2]).sum(dtype=np.float64))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all training texts."""

    def run(batches):
        held = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(words(t))
            if len(held) > 400_000:
                yield rows()
                held = Counter()
        if held:
            yield rows()

    return docs.filter(~F.col("held")).select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, units: Units, unigram: np.ndarray) -> dict:
    """One model per task over all of its training texts, averaged by tokens within GROUPS groups and then among them."""
    p0 = start(units, unigram)
    names = sorted(p0)
    shared = docs.sparkSession.sparkContext.broadcast((units, unigram, p0))

    def run(batches):
        from pyspark import TaskContext

        u, uni, p = shared.value
        trainer, seen = Trainer(p, uni), Seen(u)
        for b in batches:
            if len(seen) > 400_000:
                seen.clear()
            for t in b.column(0).to_pylist():
                w = words(t)
                trainer.add(np.append(np.fromiter(map(seen.__getitem__, w), np.int64, len(w)), 1))
        trainer.flush()
        if trainer.tokens:
            flat = np.concatenate([trainer.p[k].ravel() for k in names]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([trainer.tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())],
                ["part", "n", "model"],
            )

    def average(batches):
        sums: dict = {}
        for b in batches:
            for part, n, model in zip(*[c.to_pylist() for c in b.columns], strict=True):
                v = np.frombuffer(model, np.float32).astype(np.float64) * n
                old = sums.get(part, (0, 0))
                sums[part] = (old[0] + n, old[1] + v)
        for part, (n, v) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["part", "n", "model"])

    schema = "part int, n long, model binary"
    models = docs.filter(~F.col("held")).select("text").mapInArrow(run, schema)
    got = models.repartition(GROUPS, "part").mapInArrow(average, schema).collect()  # GROUPS rows of a fixed size
    if not got:
        return p0
    flat = sum(np.frombuffer(r["model"], np.float64) for r in sorted(got, key=lambda r: r["part"])) / sum(r["n"] for r in got)
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + p0[k].size].reshape(p0[k].shape).astype(np.float32)
        at += p0[k].size
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); texts whose crc32(id as text) mod ``fold`` is 1 are not learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col, fold).alias("held"))
    size = docs.agg(F.count("*").alias("n"), F.count_if(~F.col("held")).alias("train"), F.sum(F.char_length("text")).alias("chars")).first()
    ends = size["train"]
    counts = stored(word_counts(docs), "lbl-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (1 if ends else 0)
    top = [bytes(r["word"]) for r in counts.orderBy(F.desc("c"), "word").limit(TOP).collect()]
    units = Units(top)
    frequent = spark.createDataFrame([(w,) for w in top], "top binary")
    klass = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(CLASSES)).alias("k")
    marked = counts.join(F.broadcast(frequent), F.col("word") == F.col("top"), "left")
    per = {r["k"]: (r["n"], r["v"]) for r in marked.filter("top IS NULL").groupBy(klass).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    share = np.array([1e-9, ends, *[0] * len(top), *[per.get(k, (0, 0))[0] for k in range(CLASSES)]], float) + 0.5
    for r in marked.filter("top IS NOT NULL").collect():  # TOP rows
        share[units.top[bytes(r["word"])]] = r["c"] + 0.5
    share[0] = 1e-3
    share /= share.sum()
    model = tables(train(docs, units, share))
    known = {"n": n, "v": v, "ends": ends, "per": per, "units": units}
    shared = spark.sparkContext.broadcast((model, known))

    blocks = max(1, -(-(size["chars"] or 0) // BLOCK_CHARS))
    dealt = docs.withColumn("p", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(int(blocks), "p")

    def distinct(batches):
        held: dict[int, set] = {}
        for b in batches:
            for t, p in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                held.setdefault(p, set()).update(words(t))
        for p, own in held.items():
            own = list(own)
            for i in range(0, len(own), 50_000):
                part = own[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(part), pa.int32()), pa.array(part, pa.binary())], ["p", "word"])

    def score(texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        t, k = shared.value
        own = {w: i for i, w in enumerate(vocabulary.column("word").to_pylist())}
        c = np.append(vocabulary.column("c").to_numpy(), k["ends"]).astype(np.float64)
        base = np.log10((c + 0.5) / (k["n"] + 0.5 * (k["v"] + 1)))
        u, inside = np.empty(len(c), np.int64), np.zeros(len(c))
        room = {q: np.log(a + 0.5 * (b + 1)) for q in range(CLASSES) for a, b in [k["per"].get(q, (0, 0))]}
        for w, i in own.items():
            u[i] = unit = k["units"].of(w)
            if unit >= k["units"].base:
                inside[i] = np.log(c[i] + 0.5) - room[unit - k["units"].base]
        u[-1] = 1
        rows = []
        for key, text, held in zip(*(texts.column(x).to_pylist() for x in ("id", "text", "held")), strict=True):
            w = words(text)
            at = np.append(np.fromiter(map(own.__getitem__, w), np.int64, len(w)), len(c) - 1)
            rows.append((key, held, len(at), int((c[at] > 0).sum()), k["n"], float(base[at].sum()), (unit_score(t, u[at]) + float(inside[at].sum())) / np.log(10)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    pairs = dealt.mapInArrow(distinct, "p int, word binary")
    counted = pairs.join(counts, "word", "left").select("p", "word", F.coalesce("c", F.lit(0)).cast("long").alias("c"))
    return dealt.groupBy("p").cogroup(counted.groupBy("p")).applyInArrow(score, schema)
