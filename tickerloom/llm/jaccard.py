"""Exact near-duplicate join on word shingles with signature trees.

Texts of equal word sequences are one class, named by a hash of the sequence. For classes, shingles
are put in one global order: rare before frequent (by a counting sketch of fixed size over all
texts), then by hash. Two sets that overlap enough must share a shingle within the first
n - ceil(t n) + 1 of each (prefix filter), so

1. classes meet at prefix shingles. A meeting of at most SMALL classes gives pairs, kept if sizes and
   token bitmaps leave enough possible overlap. A larger meeting gives a star, one row per member;
2. these edges join classes into bundles (connected components): no link runs between two bundles;
3. every set travels to its bundle once (a large bundle is cut into blocks and sets travel to the block
   pairs), where a signature tree is walked against itself: nodes hold OR-combined bitmaps and
   size ranges, pairs of nodes that cannot overlap enough are pruned, and what is left is compared exactly.
   Pairs already connected are skipped; only a spanning forest of links leaves the task;
4. components of these links give each document the smallest id it reaches.

Defined cases: a null or wordless text has an empty set and links with nothing; a text of fewer words
than a shingle is one shingle of all its words; equal texts link; ties need no rule, as only sizes of
sets decide; rows without an id take part but cannot name a component unless no member has an id (then null);
rows of equal ids are documents of their own; an empty table gives an empty table; extra columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.llm.common import bounded_batches, components, stored, words

WIDTH, PERCENT = 5, 75
CELL_BITS, CELL_LOAD, BLOCKS = (20, 27), 8, 1024  # counting sketch: bits of its size, shingles per cell it aims at
SMALL = 128  # largest meeting that gives pairs
BLOCK = 2500  # largest block of a bundle
LEAF, FAN = 32, 8


class WordHash(dict):
    """64-bit hash of a word, kept for words met within a bound."""

    def __missing__(self, w):
        import xxhash

        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(toks: list[bytes], known: WordHash, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of ``width`` words in a row, sorted."""
    if len(known) > 200_000:
        known.clear()
    k, step = min(width, len(toks)), np.uint64(0x9E3779B97F4A7C15)
    if not k:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(known.__getitem__, toks), np.uint64, len(toks))
    h = a[: len(a) - k + 1] + np.uint64(k)
    for i in range(1, k):
        h = h * step + a[i : len(a) - k + 1 + i]
    return np.unique(mixed(h))


def content(toks: list[bytes]) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash of the word sequence."""
    import xxhash

    d = xxhash.xxh3_128_digest(b" ".join(toks))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(h: np.ndarray) -> bytes:
    """Token bitmap with 4 to 8 bits per shingle, a power of two; places are leading hash bits, so bitmaps can be folded."""
    bits = max(6, int(4 * len(h) - 1).bit_length())
    b = np.zeros(1 << bits, np.uint8)
    b[(h >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return np.packbits(b).tobytes()


def folded(b: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (bytes) in fewer bytes: neighbouring bits combined by OR."""
    while len(b) > size:
        bits = np.unpackbits(b)
        b = np.packbits(bits[::2] | bits[1::2])
    return b


def enough(n1: int, n2: int, overlap: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def possible(n1: int, s1: bytes, n2: int, s2: bytes, percent: int = PERCENT) -> bool:
    """Whether bitmaps leave room for enough overlap: a token whose bit the other lacks is not shared."""
    a, b = np.frombuffer(s1, np.uint8), np.frombuffer(s2, np.uint8)
    k = min(len(a), len(b))
    a, b = folded(a, k), folded(b, k)
    both = int(np.bitwise_count(a & b).sum())
    most = min(n1 - int(np.bitwise_count(a).sum()) + both, n2 - int(np.bitwise_count(b).sum()) + both, n1, n2)
    return enough(n1, n2, most, percent)


def distinct_sets(batches, width: int):
    """(id, content hash, shingles) per row of (id, text, ...) batches; later copies within a task get no set."""
    known, seen = WordHash(), set()
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            toks = words(text)
            c = content(toks)
            out.append((key, c, None if c in seen else shingles(toks, known, width)))
            seen.add(c)
        yield out


def class_rows(docs: DataFrame, width: int) -> DataFrame:
    """(id, row, c1, c2, n, sig) per document of (id, text, row); n and sig are null for later copies within a task."""

    def run(batches):
        kept = []
        for rows in distinct_sets(_noted(batches, kept), width):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    kept.pop(),
                    pa.array([r[1][0] for r in rows], pa.int64()),
                    pa.array([r[1][1] for r in rows], pa.int64()),
                    pa.array([None if r[2] is None else len(r[2]) for r in rows], pa.int64()),
                    pa.array([None if r[2] is None else bitmap(r[2]) for r in rows], pa.binary()),
                ],
                ["id", "row", "c1", "c2", "n", "sig"],
            )

    return docs.mapInArrow(run, "id long, row binary, c1 long, c2 long, n long, sig binary")


def _noted(batches, kept: list):
    """The batches, the third column of the one in work laid aside."""
    for b in batches:
        kept.append(b.column(2))
        yield b


def cell_bits(total: int) -> int:
    """Size of the counting sketch for so many shingles, within fixed bounds."""
    return min(CELL_BITS[1], max(CELL_BITS[0], int(total // CELL_LOAD).bit_length()))


def frequent_cells(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Which of 2**bits hash cells hold clearly more shingles than chance: a bitmap of bounded size (16 MB at most).

    Every task counts all of its shingles; the counts of a block of cells are summed as they stream by.
    """
    per, shift = (1 << bits) // BLOCKS, np.uint64(64 - bits)

    def packed(held):
        cell, n = np.unique((np.concatenate(held) >> shift).astype(np.int64), return_counts=True)
        cut = np.searchsorted(cell, np.arange(BLOCKS + 1) * per)
        blocks = np.flatnonzero(np.diff(cut))
        body = [
            zlib.compress(np.diff(cell[cut[k] : cut[k + 1]], prepend=k * per).astype(np.uint32).tobytes() + n[cut[k] : cut[k + 1]].astype(np.uint32).tobytes(), 1)
            for k in blocks
        ]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(body, pa.binary())], ["block", "counts"])

    def count(batches):
        held, n = [], 0
        for rows in distinct_sets(batches, width):
            got = [r[2] for r in rows if r[2] is not None and len(r[2])]
            held += got
            n += sum(map(len, got))
            if n > 1_500_000:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    def mark(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                step, n = np.frombuffer(zlib.decompress(body), np.uint32).reshape(2, -1)
                sums.setdefault(block, np.zeros(per, np.int32))[np.cumsum(step, dtype=np.int64)] += n.astype(np.int32)
        rows = []
        for block, c in sums.items():
            m = c.mean()
            rows.append((block, np.packbits(c > m + 8 * np.sqrt(m) + 8).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "hot"])

    counted = docs.mapInArrow(count, "block int, counts binary").repartition("block")
    hot = np.zeros((1 << bits) // 8, np.uint8)
    for r in counted.mapInArrow(mark, "block int, hot binary").toLocalIterator():  # BLOCKS rows at most
        hot[r["block"] * per // 8 : (r["block"] + 1) * per // 8] = np.frombuffer(r["hot"], np.uint8)
    return hot


def prefix(n: int, percent: int) -> int:
    """How many leading shingles of n a set shares at least one of with every set that it links with."""
    return n - -(-percent * n // 100) + 1


def prefix_rows(docs: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    """(key, c1, n): each class at the shingles of its prefix, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    shift = np.uint64(64 - (8 * len(hot) - 1).bit_length())

    def run(batches):
        frequent = shared.value
        for rows in distinct_sets(batches, width):
            keys, cls, size = [], [], []
            for _, c, h in rows:
                if h is None or not len(h):
                    continue
                p = prefix(len(h), percent)
                cell = h >> shift
                late = frequent[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1
                order = np.argsort(late, kind="stable")[:p]
                keys.append(h[order])
                cls.append(np.full(p, c[0], np.int64))
                size.append(np.full(p, len(h), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(size))], ["key", "c1", "n"])

    return docs.mapInArrow(run, "key long, c1 long, n int")


def meetings(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of classes of fitting sizes, or stars (sizes null) of large meetings. Streams over sorted keys; holds SMALL rows of a key."""

    def run(batches):
        key, group, hub = None, [], None
        for b in batches:
            k, c, n = (x.to_numpy() for x in b.columns)
            same = k[1:] == k[:-1]
            busy = np.concatenate([[True], same]) | np.concatenate([same, [True]])  # the ends may go on in the next batch
            out = []
            for kk, cc, nn in zip(k[busy].tolist(), c[busy].tolist(), n[busy].tolist(), strict=True):
                if kk != key:
                    out += pairs_of(group, percent)
                    key, group, hub = kk, [], None
                if hub is not None:
                    if cc != last:
                        out.append((hub, cc, None, None))
                elif not group or group[-1][0] != cc:
                    group.append((cc, nn))
                    if len(group) > SMALL:
                        hub = group[0][0]
                        out += [(hub, g[0], None, None) for g in group[1:]]
                        group = []
                last = cc
            if out:
                yield rows_of(out)
        if out := pairs_of(group, percent):
            yield rows_of(out)

    def pairs_of(group, percent):
        group = sorted(group, key=lambda g: g[1])
        out = []
        for i, (a, n) in enumerate(group):
            for b, m in group[i + 1 :]:
                if percent * m > 100 * n:
                    break
                out.append((a, b, n, m) if a < b else (b, a, m, n))
        return out

    def rows_of(out):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["a", "b", "na", "nb"])

    return prefixes.repartition("key").sortWithinPartitions("key", "c1").mapInArrow(run, "a long, b long, na int, nb int").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"))


def bundle_edges(found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of stars, and of the pairs for which neither the number of meetings nor the bitmaps rule enough overlap out.

    Behind its prefix the set whose prefix ends first has n - prefix shingles left, so the overlap is at most that
    plus the meetings. Meetings in stars are not counted, but a star has both of them in its bundle anyway.
    """

    def run(batches):
        for b in batches:
            keep = [possible(n1, s1, n2, s2, percent) for n1, s1, n2, s2 in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda k: classes.select(F.col("c1").alias(k), F.col("sig").alias(f"s{k}"))
    behind = F.greatest(*[F.ceil(F.col(n) * percent / 100) - 1 for n in ("na", "nb")])
    most = F.least(F.col("met") + behind, "na", "nb")
    pairs = found.filter(F.col("na").isNotNull() & (100 * most >= percent * (F.col("na") + F.col("nb") - most)))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return pairs.mapInArrow(run, "a long, b long").union(found.filter(F.col("na").isNull()).select("a", "b"))


class Node:
    """A node of a signature tree: combined bitmap, size range, most tokens hidden by shared bits, and members or children."""

    __slots__ = ("bits", "low", "high", "hidden", "members", "children")

    def __init__(self, bits, low, high, hidden, members, children):
        self.bits, self.low, self.high, self.hidden, self.members, self.children = bits, low, high, hidden, members, children


class Forest:
    """Union by smallest root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


class SignatureTree:
    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.n = sets, np.array([len(s) for s in sets])
        width = min(16, max(6, int(4 * self.n.max() - 1).bit_length()))
        self.sig = np.zeros((len(sets), (1 << width) // 64), np.uint64)
        for i, s in enumerate(sets):
            at = np.unique(s >> np.uint64(64 - width))
            np.bitwise_or.at(self.sig[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.hidden = self.n - np.bitwise_count(self.sig).sum(1, dtype=np.int64)
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), int(self.n[i]), i))  # equal least hashes stand together
        nodes = [self._leaf(np.array(order[i : i + LEAF])) for i in range(0, len(order), LEAF)]
        while len(nodes) > 1:
            nodes = [self._over(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        self.top = nodes[0]

    def _leaf(self, m):
        return Node(np.bitwise_or.reduce(self.sig[m], 0), int(self.n[m].min()), int(self.n[m].max()), int(self.hidden[m].max()), m, [])

    @staticmethod
    def _over(c):
        return Node(np.bitwise_or.reduce([x.bits for x in c], 0), min(x.low for x in c), max(x.high for x in c), max(x.hidden for x in c), None, c)

    def links(self, percent: int = PERCENT) -> Forest:
        """Walk the tree against itself; the forest of linked members."""
        forest, stack = Forest(len(self.sets)), [(self.top, self.top)]
        while stack:
            x, y = stack.pop()
            if x is not y:
                if percent * y.low > 100 * x.high or percent * x.low > 100 * y.high:
                    continue
                most = min(int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.hidden, y.hidden), x.high, y.high)
                if not enough(x.low, y.low, most, percent):
                    continue
            if x.children and y.children:
                if x is y:
                    stack += [(a, b) for i, a in enumerate(x.children) for b in x.children[i:]]
                else:
                    stack += [(a, b) for a in x.children for b in y.children]
            elif x.children:
                stack += [(a, y) for a in x.children]
            elif y.children:
                stack += [(x, b) for b in y.children]
            else:
                self._compare(x.members, y.members, forest, percent)
        return forest

    def _compare(self, xs, ys, forest, percent):
        rx, ry = {forest.root(i) for i in xs}, {forest.root(i) for i in ys}
        if len(rx | ry) == 1:
            return
        both = np.bitwise_count(self.sig[xs][:, None, :] & self.sig[ys][None, :, :]).sum(2, dtype=np.int64)
        most = both + np.minimum(self.hidden[xs][:, None], self.hidden[ys][None, :])
        n, m = self.n[xs][:, None], self.n[ys][None, :]
        most = np.minimum(most, np.minimum(n, m))
        for i, j in zip(*np.nonzero(100 * most >= percent * (n + m - most)), strict=True):
            a, b = int(xs[i]), int(ys[j])
            if a == b or forest.root(a) == forest.root(b):
                continue
            s, t = self.sets[a], self.sets[b]
            if enough(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)), percent):
                forest.join(a, b)


def linked_in_bundles(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning links within each (bundle, i, j) of rows (bundle, i, j, c1, h)."""

    def finish(group):
        group = sorted(dict(group).items())
        if len(group) < 2:
            return []
        names = [g[0] for g in group]
        forest = SignatureTree([np.frombuffer(g[1], np.uint64) for g in group]).links(percent)
        return [(names[forest.root(i)], names[i]) for i in range(len(names)) if forest.root(i) != i]

    def run(batches):
        key, group = None, []
        for b in batches:
            out = []
            for *k, c, h in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if k != key:
                    out += finish(group)
                    key, group = k, []
                group.append((c, h))
            if out:
                yield edges(out)
        if out := finish(group):
            yield edges(out)

    def edges(out):
        a, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sets.repartition("bundle", "i", "j").sortWithinPartitions("bundle", "i", "j").mapInArrow(run, "a long, b long")


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and whole text; rows equal in both are the same to the join."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit("")))))


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, row, size, label, component) of every row: the size of its set, its component by hash and by smallest id."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
    docs = keyed.drop("row")
    bounded_batches(spark)
    rows = stored(class_rows(keyed, width), "jac-rows")
    classes = stored(rows.groupBy("c1").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig")), "jac-classes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    hot = frequent_cells(docs, width, cell_bits(total))
    prefixes = prefix_rows(docs, hot, width, percent)
    found = stored(meetings(prefixes, percent), "jac-meetings")
    bundles = components(bundle_edges(found, classes, percent), "jac-bundle").select(F.col("node").alias("c1"), F.col("label").alias("bundle"))
    bundles = stored(bundles, "jac-bundles")
    parts = bundles.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    here = F.pmod(F.xxhash64("c1"), F.col("parts")).cast("int")
    members = (
        bundles.join(parts, "bundle")
        .join(classes.select("c1", "rep"), "c1")
        .select("bundle", "c1", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"), here.alias("p"))
        .select("bundle", "c1", "rep", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"))
    )
    wanted = stored(sets_of(docs, members.select("rep", "c1").distinct(), width), "jac-sets")
    where = members.select("bundle", "i", "j", "c1")
    links = linked_in_bundles(where.join(wanted, "c1").select("bundle", "i", "j", "c1", "h"), percent)
    labels = components(links, "jac-links")
    known = classes.join(labels, classes["c1"] == labels["node"], "left").select("c1", "rep", "n", F.coalesce("label", "c1").alias("label"))
    least = known.groupBy("label").agg(F.min("rep").alias("component"))
    final = known.join(least, "label").select("c1", F.col("n").alias("size"), "label", "component")
    return rows.select("id", "row", "c1").join(final, "c1").select("id", "row", "size", "label", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    out = labelled_rows(docs, id_col, text_col, width, percent)
    component = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"))


def sets_of(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(c1, h): the whole set of each class in a bundle, from the text of its representative."""

    def run(batches):
        known = WordHash()
        for b in batches:
            got = []
            for c1, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                toks = words(text)
                if content(toks)[0] == c1:  # an id that stands on several texts
                    got.append((c1, shingles(toks, known, width).tobytes()))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["c1", "h"])

    return docs.join(reps, docs["id"].eqNullSafe(reps["rep"])).select("c1", "text").mapInArrow(run, "c1 long, h binary")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest id, rows without an id last, then by key.

    Rows are told apart by id and text, so different texts of one id, or without an id, stand on their own; of rows
    equal in both one stays. Rows without a word link with nothing and all stay.
    """
    wordless = ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = labelled_rows(docs.filter(~wordless), id_col, text_col, width, percent)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("r"))
    keep = stored(first.select(F.col("r.row").alias("_jac_row")), "jac-keep")
    chosen = docs.filter(~wordless).withColumn("_jac_row", row_key(id_col, text_col)).join(keep, "_jac_row", "left_semi")
    return chosen.dropDuplicates(["_jac_row"]).select(*docs.columns).unionByName(docs.filter(wordless))
