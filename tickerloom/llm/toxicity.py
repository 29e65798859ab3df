"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a step: a word, as the sum of a hashed word vector and the mean of hashed vectors of its
character trigrams (with word ends). Both input projections depend on the word alone, so a worker
keeps one projected row per word it has met, within a bound, and the recurrence is left to do for
windows. Every text is scored over all overlapping windows of WINDOW words, STRIDE apart, and the
score of a document is a calibrated logistic of its highest window.

Training: at most ``fit_docs`` labelled documents per class (in hash order of their ids), the documented
bound of the sample. Every fitted document is split whole into windows. A positive document names no
window, so the window with the most positive evidence (log odds of words and trigrams over the
sample) is its example; negatives are the windows with the most evidence and others of negative documents.
Twice during training the network itself picks the examples anew. The logistic on top is fitted on document maxima, weighted
by the shares of the classes among all labels.

Defined cases: null, empty and blank texts are scored as one window of padding; rows without a label
are scored, not learned from; repeated labels of a document count once (the highest); an empty table gives an empty
table; with no label of one class the score is the share of positive labels, or 0 without any label. Only the
id and the text are read, extra columns do not matter.
"""

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.common import held_out, map_rows

WINDOW, STRIDE = 32, 24
WORD_ROWS, GRAM_ROWS, DIM, HIDDEN = 4096, 16384, 12, 12
FIT_DOCS = 800
REMEMBERED = 100_000
CHUNK = 1024  # windows in memory at once

_token = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    return _token(text.lower()) if text else []


def word_row(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_ROWS


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def window_starts(n: int) -> list[int]:
    """Starts of windows that overlap and reach the end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Network:
    """Parameters p and the passes over windows of word vectors."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, seed: int = 7) -> "Network":
        r = np.random.default_rng(seed)
        g = lambda *s, f=1.0: (r.standard_normal(s) * f).astype(np.float32)
        p = {"word": g(WORD_ROWS, DIM, f=0.1), "gram": g(GRAM_ROWS, DIM, f=0.1)}
        for d in "fb":
            p |= {f"w{d}": g(DIM, 3 * HIDDEN, f=DIM**-0.5), f"u{d}": g(HIDDEN, 3 * HIDDEN, f=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"att": g(2 * HIDDEN, f=0.3), "out": g(2 * HIDDEN, f=0.3), "bias": np.zeros(1, np.float32)}
        return cls(p)

    def forward(self, x: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """x: per direction (steps, windows, 3 hidden) projected inputs; mask (steps, windows). Logits, and what backward needs."""
        p, steps, n = self.p, mask.shape[0], mask.shape[1]
        both, trace = np.zeros((steps, n, 2 * HIDDEN), np.float32), {}
        for d, order, at in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), HIDDEN)):
            h, u, seen = np.zeros((n, HIDDEN), np.float32), p[f"u{d}"], []
            for t in order:
                m = mask[t][:, None]
                a = x[d][t]
                r = h @ u
                z = sigmoid(a[:, :HIDDEN] + r[:, :HIDDEN])
                q = sigmoid(a[:, HIDDEN : 2 * HIDDEN] + r[:, HIDDEN : 2 * HIDDEN])
                c = np.tanh(a[:, 2 * HIDDEN :] + q * r[:, 2 * HIDDEN :])
                new = h + m * z * (c - h)
                if keep:
                    seen.append((t, h, z, q, c, r[:, 2 * HIDDEN :]))
                h = new
                both[t, :, at : at + HIDDEN] = h
            trace[d] = seen
        e = both @ p["att"] + (mask - 1) * 1e4
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = (a[:, :, None] * both).sum(0)
        return pooled @ p["out"] + p["bias"][0], (both, a, pooled, trace)

    def gradients(self, x, mask, want, weight):
        p = self.p
        logit, (both, a, pooled, trace) = self.forward(x, mask, keep=True)
        dl = ((sigmoid(logit) - want) * weight / len(want)).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * p["out"][None, :]
        da = (both * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnh->h", de, both)
        db = a[:, :, None] * dp + de[:, :, None] * p["att"]
        dx = {}
        for d, at in (("f", 0), ("b", HIDDEN)):
            u, dh = p[f"u{d}"], np.zeros((len(want), HIDDEN), np.float32)
            du, dxd = np.zeros_like(u), np.zeros_like(x[d])
            for t, h, z, q, c, rc in reversed(trace[d]):
                m = mask[t][:, None]
                dh = dh + db[t, :, at : at + HIDDEN]
                dc = dh * m * z * (1 - c * c)
                dz = dh * m * (c - h) * z * (1 - z)
                dq = dc * rc * q * (1 - q)
                dr = np.concatenate([dz, dq, dc * q], 1)
                dxd[t] = np.concatenate([dz, dq, dc], 1)
                du += h.T @ dr
                dh = dh * (1 - m * z) + dr @ u.T
            g[f"u{d}"], dx[d] = du, dxd
        return g, dx


class Vocabulary:
    """Rows of word vectors for words met; row 0 is padding."""

    def __init__(self, project=None, bound: int = REMEMBERED):
        self.row, self.project, self.bound, self.words, self.rows = {}, project, bound, [""], None

    def ids(self, toks: list[str]) -> np.ndarray:
        row = self.row
        new = [w for w in dict.fromkeys(toks) if w not in row]
        for w in new:
            row[w] = len(self.words)
            self.words.append(w)
        return np.fromiter(map(row.__getitem__, toks), np.int32, len(toks))


def word_inputs(words: list[str]):
    """Row of each word, flat rows of its trigrams of ``^word$``, their starts and numbers; hashed for all words at once."""
    marked = [f"^{w or ' '}$" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked)) - 2
    c = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    grams = (h >> np.uint64(40)).astype(np.int64) % GRAM_ROWS
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(words)), size)
    return np.array([word_row(w) for w in words]), grams[np.arange(len(owner)) + 2 * owner], starts, size


def projected(p, words: list[str]) -> np.ndarray:
    """Per word the inputs of both directions, 6 hidden wide; the empty word (padding) gets zeros."""
    if not words:
        return np.zeros((0, 6 * HIDDEN), np.float32)
    rows, grams, starts, size = word_inputs(words)
    v = p["word"][rows] + np.add.reduceat(p["gram"][grams], starts, 0) / size[:, None].astype(np.float32)
    out = np.concatenate([v @ p["wf"] + p["cf"], v @ p["wb"] + p["cb"]], 1).astype(np.float32)
    out[[i for i, w in enumerate(words) if not w]] = 0
    return out


def windows_of(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) word rows, 0 for padding."""
    if len(ids) <= WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None, :]
    return ids[np.array(window_starts(len(ids)))[:, None] + np.arange(WINDOW)]


class Scorer:
    """Highest window logit of texts; keeps projected words within a bound."""

    def __init__(self, p):
        self.net, self.p = Network(p), p
        self.reset()

    def reset(self):
        """One table per direction and gate, so that every array of the recurrence is contiguous."""
        self.row, self.used = {"": 0}, 1
        self.tables = [np.zeros((1024, HIDDEN), np.float32) for _ in range(6)]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        toks = [tokens(t) for t in texts]
        if self.used > REMEMBERED:
            self.reset()
        new = [w for w in dict.fromkeys(w for t in toks for w in t) if w not in self.row]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            if (need := self.used + len(part)) > len(self.tables[0]):
                self.tables = [np.concatenate([t, np.zeros((max(need - len(t), len(t)), HIDDEN), np.float32)]) for t in self.tables]
            got = projected(self.p, part)
            for k, t in enumerate(self.tables):
                t[self.used : need] = got[:, k * HIDDEN : (k + 1) * HIDDEN]
            self.row.update(zip(part, range(self.used, need), strict=True))
            self.used = need
        row = self.row.__getitem__
        return [np.fromiter(map(row, t), np.int32, len(t)) for t in toks]

    def states(self, w: np.ndarray, mask: np.ndarray, d: int) -> np.ndarray:
        """Hidden states (steps, windows, HIDDEN) of one direction, as in Network.forward."""
        tz, tq, tc = self.tables[3 * d : 3 * d + 3]
        u = self.p["u" + "fb"[d]]
        uz, uq, uc = (np.ascontiguousarray(u[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        out = np.empty((*w.shape, HIDDEN), np.float32)
        h = np.zeros((w.shape[1], HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for t in range(len(w)) if d == 0 else range(len(w) - 1, -1, -1):
                z = 1 / (1 + np.exp(-(h @ uz + tz.take(w[t], 0))))
                q = 1 / (1 + np.exp(-(h @ uq + tq.take(w[t], 0))))
                c = np.tanh(tc.take(w[t], 0) + q * (h @ uc))
                h = h + z * (c - h) * mask[t][:, None]
                out[t] = h
        return out

    def logits(self, win: np.ndarray) -> np.ndarray:
        out, att, top = np.empty(len(win), np.float32), self.p["att"], self.p["out"]
        for i in range(0, len(win), CHUNK):
            w = np.ascontiguousarray(win[i : i + CHUNK].T)
            mask = (w > 0).astype(np.float32)
            f, b = self.states(w, mask, 0), self.states(w, mask, 1)
            e = f @ att[:HIDDEN] + b @ att[HIDDEN:] + (mask - 1) * 1e4
            e = np.exp(e - e.max(0))
            e /= e.sum(0)
            out[i : i + CHUNK] = (e * (f @ top[:HIDDEN] + b @ top[HIDDEN:])).sum(0) + self.p["bias"][0]
        return out

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """Texts are taken in groups of about CHUNK windows, so memory follows neither batch nor text."""
        out, group, size = np.empty(len(texts), np.float32), [], 0
        for i, ids in enumerate(self.ids(texts)):
            win = windows_of(ids)
            group.append((i, win))
            size += len(win)
            if size >= CHUNK or i == len(texts) - 1:
                got = self.logits(np.concatenate([w for _, w in group]))
                at = np.cumsum([0] + [len(w) for _, w in group])
                for k, (j, _) in enumerate(group):
                    out[j] = got[at[k] : at[k + 1]].max()
                group, size = [], 0
        return out


def fit(texts: list[str], labels: list[int], share: float, epochs: int = 6, steps: int = 200, seed: int = 7) -> dict:
    """Parameters and calibration from a bounded sample."""
    r, y = np.random.default_rng(seed), np.array(labels)
    voc = Vocabulary()
    docs = [voc.ids(tokens(t)) for t in texts]
    rows, grams, starts, size = word_inputs(voc.words)
    odds = evidence(docs, y, grams, starts)
    wins = [windows_of(d) for d in docs]
    pick = [w[np.argsort(-odds[w].max(1), kind="stable")[:1]] for w in wins]
    net, adam = Network.fresh(seed), {}
    per = max(1, 2 * len(docs) // 96)
    epochs = min(max(epochs, -(-steps // per)), 60)
    for epoch in range(epochs):
        if epoch in (epochs // 4, epochs // 2):
            pick = hardest(net, wins, rows, grams, starts, size)
        x = list(pick)
        lab = list(y)
        for w, k in zip(wins, y, strict=True):
            if not k and len(w) > 1:
                x.append(w[r.integers(len(w), size=1)])
                lab += [0]
        x, lab = np.concatenate(x), np.array(lab, np.float32)
        for part in np.array_split(r.permutation(len(x)), max(1, len(x) // 96)):
            step(net, x[part], lab[part], rows, grams, starts, size, adam, 0.02 * (1 - 0.9 * epoch / epochs))
    p = net.p
    top = Scorer(p).highest(texts)
    a, b = logistic(top, y, np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())))
    return p | {"cal": np.array([a, b])}


def evidence(docs, y, grams, starts) -> np.ndarray:
    """Per word: the largest of the smoothed log odds of the word and of its grams by documents that hold them."""
    count = np.zeros((2, GRAM_ROWS))
    own = np.zeros((2, int(len(starts))))
    ends = np.append(starts[1:], len(grams))
    for d, k in zip(docs, y, strict=True):
        u = np.unique(d)
        own[k][u] += 1
        if len(u):
            count[k][np.unique(np.concatenate([grams[starts[i] : ends[i]] for i in u]))] += 1
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    lo = lambda c: np.log((c[1] + 0.5) / n[1]) - np.log((c[0] + 0.5) / n[0]) - 2 / np.sqrt(c.sum(0) + 1)
    out = np.maximum(lo(own), np.maximum.reduceat(lo(count)[grams], starts))
    out[0] = -9
    return out


def inputs(net, win, rows, grams, starts, size):
    """Word vectors and projections of the words of some windows."""
    words, at = np.unique(win, return_inverse=True)
    ends = np.append(starts[1:], len(grams))
    flat = np.concatenate([grams[starts[i] : ends[i]] for i in words])
    owner = np.repeat(np.arange(len(words)), size[words])
    mean = np.zeros((len(words), DIM), np.float32)
    np.add.at(mean, owner, net.p["gram"][flat])
    v = net.p["word"][rows[words]] + mean / size[words][:, None].astype(np.float32)
    v[words == 0] = 0
    at = at.reshape(win.shape).T
    x = {d: (v @ net.p[f"w{d}"] + net.p[f"c{d}"] * (words > 0)[:, None])[at] for d in "fb"}
    return words, at, flat, owner, v, x


def step(net, win, want, rows, grams, starts, size, adam, lr):
    """One Adam step on a batch of windows; hashed rows are updated where they were used."""
    words, at, flat, owner, v, x = inputs(net, win, rows, grams, starts, size)
    mask = (win.T > 0).astype(np.float32)
    pos = want.mean()
    weight = np.where(want == 1, 0.5 / max(pos, 0.02), 0.5 / max(1 - pos, 0.02)).astype(np.float32)
    g, dx = net.gradients(x, mask, want, weight)
    dv = np.zeros_like(v)
    real = (words > 0)[:, None]
    for d in "fb":
        per = np.zeros((len(words), 3 * HIDDEN), np.float32)
        np.add.at(per, at.ravel(), dx[d].reshape(-1, 3 * HIDDEN))
        per *= real
        g[f"w{d}"], g[f"c{d}"] = v.T @ per, per.sum(0)
        dv += per @ net.p[f"w{d}"].T
    for name, idx, grad in (("word", rows[words], dv), ("gram", flat, (dv / size[words][:, None])[owner])):
        used, inv = np.unique(idx, return_inverse=True)
        part = np.zeros((len(used), DIM), np.float32)
        np.add.at(part, inv, grad)
        update(net.p[name], adam, name, part, lr, used)
    for name, grad in g.items():
        update(net.p[name], adam, name, grad, lr)


def update(param, adam, name, grad, lr, rows=slice(None)):
    m, s, n = adam.setdefault(name, [np.zeros_like(param), np.zeros_like(param), 0])
    adam[name][2] = n = n + 1
    m[rows] = 0.9 * m[rows] + 0.1 * grad
    s[rows] = 0.99 * s[rows] + 0.01 * grad * grad
    param[rows] -= lr * (m[rows] / (1 - 0.9**n)) / (np.sqrt(s[rows] / (1 - 0.99**n)) + 1e-6)


def hardest(net, wins, rows, grams, starts, size):
    """Each document's window with the highest logit under the network so far."""
    flat = np.concatenate(wins)
    got = np.empty(len(flat), np.float32)
    for i in range(0, len(flat), CHUNK):
        w = flat[i : i + CHUNK]
        got[i : i + CHUNK] = net.forward(inputs(net, w, rows, grams, starts, size)[-1], (w.T > 0).astype(np.float32))[0]
    at = np.cumsum([0] + [len(w) for w in wins])
    return [w[[int(got[a:b].argmax())]] for w, a, b in zip(wins, at[:-1], at[1:], strict=True)]


def logistic(x, y, weight, steps: int = 60):
    """a, b of sigmoid(a x + b) by weighted Newton steps with a small ridge."""
    x = np.clip(np.asarray(x, float), -30, 30)
    a, b = 1.0, 0.0
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(steps):
        q = sigmoid(a * x + b)
        gr = np.array([(weight * (q - y) * x).sum(), (weight * (q - y)).sum()]) + ridge @ [a, b]
        w = weight * q * (1 - q) + 1e-9
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + ridge
        da, db = np.clip(np.linalg.solve(h, gr), -2, 2)
        a, b = a - da, b - db
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> dict:
    """Fit on at most ``fit_docs`` documents per class, those with the smallest id hashes, of the labelled rows that are not held out."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 3))
        .groupBy(F.col(id_col).cast(kind).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    )
    total = known.agg(F.count("*").alias("n"), F.sum("_y").alias("pos")).first()
    n, pos = total["n"] or 0, total["pos"] or 0
    if not n or not pos or pos == n:
        return {"share": np.array([pos / n if n else 0.0])}
    parts = [known.filter(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(fit_docs).collect() for k in (0, 1)]
    chosen = spark.createDataFrame([(r["_id"], r["_y"]) for part in parts for r in part], known.schema)
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).groupBy("_id").agg(F.max(text_col).alias("t"), F.max("_y").alias("y")).collect()
    rows.sort(key=lambda r: r["_id"])
    if len({r["y"] for r in rows}) < 2:
        return {"share": np.array([pos / n])}
    return fit([r["t"] or "" for r in rows], [r["y"] for r in rows], pos / n)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): highest window of every whole text, calibrated. The model has a fixed size and travels with the task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    scorers: list[Scorer] = []

    def rows(cols):
        p = shared.value
        if "cal" not in p:
            return [(k, float(p["share"][0])) for k in cols[0]]
        if not scorers:
            scorers.append(Scorer(p))
        a, b = p["cal"]
        return [(k, float(s)) for k, s in zip(cols[0], sigmoid(a * scorers[0].highest(cols[1]) + b), strict=True)]

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, score double", rows)


def clean(docs: DataFrame, model: dict, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose score is below ``limit``, all columns as they are; scored and filtered in one pass, without a join."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    def run(batches):
        p = shared.value
        for b in batches:
            if "cal" not in p:
                if p["share"][0] < limit:
                    yield b
                continue
            if not scorers:
                scorers.append(Scorer(p))
            a, c = p["cal"]
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array(sigmoid(a * scorers[0].highest(texts) + c) < limit))

    return docs.mapInArrow(run, docs.schema)
