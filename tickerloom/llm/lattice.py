"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected by TABLES fixed random 8-column matrices and decoded to the nearest point of
the E8 lattice; a vector stands in its own cell of every table and probes the PROBES neighbouring cells
that lie nearest to it (the 240 shortest lattice vectors are the neighbours). Two vectors meet where
one stands in a cell in which the other stands or probes.

In a meeting, vectors whose 256-bit sign sketches differ in at most NEAR bits are a pair (cosine 0.9 means 37
differing bits on average, more than NEAR about once in a million pairs; chance gives 128). Pairs are verified on the
vectors before they join anything: sketches of unlike vectors agree now and then, and with the number of vectors such edges
would in the end chain most of the table together. A meeting with more than DENSE pairs a member gives a spanning forest
and one of more than LARGE vectors a star, one row per member and not verified, so no cell has a cap.
These edges join vectors into bundles (components). Every vector travels to its bundle once;
a large bundle is cut into blocks whose pairs are compared by matrix products in double precision. So every
link inside a bundle is counted and verified, and what leaves a task is one count per vector and a spanning forest.
No table that grows with the vectors is sent to every task: the driver builds such copies.
Recall counts pairs that never meet: above 0.9 at cosine 0.9 and rising quickly above it (tested).

Equal vectors are one class with a multiplicity and are not compared.

Defined cases: vectors that are null, empty, zero, of another length than most in their class of length, or that
hold null or non-finite components link with nothing (0 links, component is their own id); vectors of
different lengths never link; ids may repeat: each row counts as a vector; a null id is kept as null; an
empty table gives an empty table; labels and other columns are not read.
"""

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.llm.common import bounded_batches, components, stored

TABLES, PROBES, SCALE, SEED = 12, 8, 0.95, 20
BITS, NEAR, LARGE, DENSE, BLOCK = 256, 65, 2048, 16, 1500
SENT = str(1 << 20)  # bytes of a table up to which it goes to every task; several are held by the driver at a time


def shortest_vectors() -> np.ndarray:
    """The 240 roots of E8: two entries of 1 or -1, or all halves with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        s = np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)])
        if (s < 0).sum() % 2 == 0:
            out.append(s)
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with even sum: round, and where the sum is odd round the worst entry the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    d = x[odd] - r[odd]
    k = np.abs(d).argmax(1)
    r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


def cell_keys(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """64-bit name of cells of one table."""
    h = np.full(points.shape[:-1], np.uint64(table * 1_000_003 + dim), np.uint64)
    twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    for k in range(8):
        h = (h ^ twice[..., k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def projection(dim: int, table: int, scale: float) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table]).standard_normal((dim, 8)) / scale


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE):
    """Own cell and probed cells of unit vectors: (n, tables), (n, tables, probes)."""
    roots, n = shortest_vectors(), len(unit)
    own, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        x = unit @ projection(unit.shape[1], t, scale)
        c = nearest_e8(x)
        own[:, t] = cell_keys(c, t, unit.shape[1])
        if probes:
            order = np.argpartition(-((x - c) @ roots.T), probes - 1, axis=1)[:, :probes]
            near[:, t] = cell_keys(c[:, None, :] + roots[order], t, unit.shape[1])
    return own, near


def usable(v) -> bool:
    return bool(v is not None and len(v) and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v))


def class_rows(vectors: DataFrame) -> DataFrame:
    """(id, c, v): class hash and the vector as doubles; both null for vectors that link with nothing."""

    def run(batches):
        import xxhash

        for b in batches:
            raw = []
            for v in b.column(1).to_pylist():
                raw.append(np.asarray(v, np.float64).tobytes() if usable(v) else None)
            name = [None if r is None else xxhash.xxh3_64_intdigest(r) - 2**63 for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.int64()), pa.array(raw, pa.binary())], ["id", "c", "v"])

    return vectors.mapInArrow(run, "id long, c long, v binary")


def unit_of(raw: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def sketches(unit: np.ndarray) -> np.ndarray:
    """Signs of random projections as 64-bit words."""
    plane = np.random.default_rng([SEED, unit.shape[1], 1 << 20]).standard_normal((unit.shape[1], BITS))
    return np.packbits(unit @ plane > 0, axis=1).view(np.int64)


def cell_rows(classes: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """(key, guest, c, s0, s1, ...): guest is false in the own cell, true in probed cells."""
    words = [f"s{k}" for k in range(BITS // 64)]

    def run(batches):
        for b in batches:
            names, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            for size in sorted({len(r) for r in raw}):
                every = [i for i, r in enumerate(raw) if len(r) == size]
                for at in (every[i : i + 500] for i in range(0, len(every), 500)):
                    unit = unit_of([raw[i] for i in at])
                    own, near = cells(unit, tables, probes, scale)
                    c, s = np.array([names[i] for i in at], np.int64), sketches(unit)
                    keys = np.concatenate([own.ravel(), near.ravel()])
                    who = np.concatenate([np.repeat(np.arange(len(at)), tables), np.repeat(np.arange(len(at)), tables * probes)])
                    guest = np.arange(len(keys)) >= own.size
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, guest, c[who], *s[who].T)], ["key", "guest", "c", *words])

    return classes.select("c", "v").mapInArrow(run, "key long, guest boolean, c long, " + ", ".join(f"{w} long" for w in words))


def least_roots(near: np.ndarray) -> np.ndarray:
    """Least member reached from each member of a symmetric graph."""
    root = np.arange(len(near))
    while True:
        best = np.where(near, root[None, :], len(root)).min(1, initial=len(root))
        new = np.minimum(root, best)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def meetings(rows: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b, dense), a < b, from cells in which someone stands. Rows stream by key, own vectors first; at most LARGE of a key
    are held. ``dense``: an edge of a forest or a star, which stands for more pairs than itself."""

    def run(batches):
        key, group, hub = None, [], None
        for b in batches:
            cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            same = cols[0][1:] == cols[0][:-1]
            busy = np.concatenate([[True], same]) | np.concatenate([same, [True]])  # the ends may go on in the next batch
            out = []
            for k, g, *rest in zip(*[c[busy].tolist() for c in cols], strict=True):
                if k != key:
                    out += edges(group)
                    key, group, hub = k, [], None
                if hub is not None:
                    out.append((hub, rest[0], True))
                elif group or not g:  # a cell that nobody stands in makes no meeting
                    group.append((g, *rest))
                    if len(group) > LARGE:
                        hub = group[0][1]
                        out += [(hub, x[1], True) for x in group[1:]]
                        group = []
            if out:
                yield rows_of(out)
        if out := edges(group):
            yield rows_of(out)

    def edges(group):
        if len(group) < 2:
            return []
        guest = np.array([g[0] for g in group])
        s = np.array([g[2:] for g in group], np.int64).view(np.uint64)
        close = (np.bitwise_count(s[:, None, :] ^ s[None, :, :]).sum(2, dtype=np.int32) <= near) & ~(guest[:, None] & guest[None, :])
        i, j = np.nonzero(np.triu(close, 1))
        if len(i) <= DENSE * len(group):
            return [(group[x][1], group[y][1], False) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        root = least_roots(close)
        return [(group[r][1], group[i][1], True) for i, r in enumerate(root.tolist()) if r != i]

    def rows_of(out):
        a, b, dense = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(dense)], ["a", "b", "dense"])

    met = rows.repartition("key").sortWithinPartitions("key", "guest", "c").mapInArrow(run, "a long, b long, dense boolean").filter("a != b")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("dense").alias("dense"))


def verified(found: DataFrame, classes: DataFrame, limit: float) -> DataFrame:
    """(a, b) of the dense edges and of those pairs whose vectors are as near as ``limit``."""
    side = lambda k: classes.select(F.col("c").alias(k), F.col("v").alias(f"v{k}"))

    def run(batches):
        for b in batches:
            a, c, x, y = (k.to_pylist() for k in b.columns)
            keep = np.zeros(len(a), bool)
            size = np.array([len(r) if len(r) == len(s) else 0 for r, s in zip(x, y, strict=True)])
            for n in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == n)
                keep[at] = np.einsum("ij,ij->i", unit_of([x[i] for i in at]), unit_of([y[i] for i in at])) >= limit - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"]).filter(pa.array(keep))

    pairs = found.filter("not dense").select("a", "b")
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "va", "vb")
    return found.filter("dense").select("a", "b").union(both.mapInArrow(run, "a long, b long"))


def linked(members: DataFrame, limit: float) -> DataFrame:
    """Rows (bundle, i, j, p, c, m, v) to (c, links, root) per block pair; root: a linked class of the block pair."""

    def finish(group):
        out = []
        for size in sorted({len(g[3]) for g in group}):
            part = [g for g in group if len(g[3]) == size]
            u = unit_of([g[3] for g in part])
            p, c, m = (np.array([g[k] for g in part], np.int64) for k in range(3))
            i, j = part[0][4]
            near = u @ u.T >= limit
            np.fill_diagonal(near, False)
            if i != j:
                near &= p[:, None] != p[None, :]
            links = near @ m
            root = least_roots(near)
            out += [(int(c[k]), int(links[k]), int(c[root[k]])) for k in range(len(part)) if links[k]]
        return out

    def run(batches):
        key, group = None, []
        for b in batches:
            out = []
            for bundle, i, j, p, c, m, v in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if (bundle, i, j) != key:
                    out += finish(group)
                    key, group = (bundle, i, j), []
                group.append((p, c, m, v, (i, j)))
            if out:
                yield rows_of(out)
        if out := finish(group):
            yield rows_of(out)

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["c", "links", "root"])

    return members.repartition("bundle", "i", "j").sortWithinPartitions("bundle", "i", "j").mapInArrow(run, "c long, links long, root long")


@contextmanager
def small_broadcasts(spark: SparkSession):
    """Joins planned inside send tables up to SENT to every task, so that the driver's share does not follow the tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, SENT)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.9, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    bounded_batches(vectors.sparkSession)
    with small_broadcasts(vectors.sparkSession):
        rows = stored(class_rows(vectors.select(F.col(id_col).cast("long").alias("id"), vector_col)), "lat-rows")
        classes = stored(
            rows.filter(F.col("c").isNotNull()).groupBy("c").agg(F.count("*").alias("m"), F.min("id").alias("rep"), F.max("v").alias("v")), "lat-classes"
        )
        found = stored(meetings(cell_rows(classes, tables, probes, scale)), "lat-meetings")
        bundles = components(verified(found, classes, limit), "lat-bundle").select(F.col("node").alias("c"), F.col("label").alias("bundle"))
        bundles = stored(bundles, "lat-bundles")
        parts = bundles.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        members = (
            bundles.join(parts, "bundle")
            .withColumn("p", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .join(classes.select("c", "m", "v").hint("merge"), "c")
            .select("bundle", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), "p", "c", "m", "v")
        )
        out = stored(linked(members, limit), "lat-links")
        labels = components(out.select(F.col("c").alias("a"), F.col("root").alias("b")), "lat-links")
        count = out.groupBy("c").agg(F.sum("links").alias("links")).withColumnRenamed("c", "_lc")
        known = (
            classes.join(count, F.col("c") == F.col("_lc"), "left")
            .join(labels, F.col("c") == F.col("node"), "left")
            .select("c", "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "c").alias("label"))
        )
        least = known.groupBy("label").agg(F.min("rep").alias("component"))
        final = known.join(least, "label").select(F.col("c").alias("_fc"), "n_links", "component")
        done = rows.select("id", "c").join(final, F.col("c") == F.col("_fc"), "left")
        component = F.coalesce("component", "id")
        out = done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
        return stored(out, "lat-out")
