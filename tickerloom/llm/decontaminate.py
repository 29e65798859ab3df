"""Benchmark passages in training texts: a broadcast hash set of word windows, DataFrame functions only.

Words are maximal runs of digits, letters (only A-Z lowered) and characters beyond ASCII. The windows of an
item are its runs of ``width`` words in a row; an item of fewer words, but not none, is one window. Each distinct
window is keyed by a 64-bit hash. The texts are scanned once: every place of a text looks its own window up in the
broadcast set, inside one generated stage, and a hit is verified word by word. A broadcast holds at most
``BLOCK_BYTES`` of windows; a larger set is dealt into blocks by hash and the texts are scanned once per block.

From the hits come the digest per document, the spans of hit words, and two ways to clean: dropping the documents
or cutting the spans. Hits belong to a text, not to a row: copies of a text share theirs, so a hot text is
counted once, and rows of equal ids, or without one, each keep their own result.

Defined cases: a null or empty text has no words; a null or wordless item has no window; items of equal texts all
count; a null item id counts as the text "null"; an empty table of items leaves every document clean; extra columns
are not read by ``contamination`` and kept by the two cleaning forms.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.llm.common import stored

WIDTH = 10
BLOCK_BYTES = 64 << 20  # most bytes of windows in one broadcast
ROW_BYTES = 64  # counted per window besides its words
SPREAD = 32  # ways that the rows of one text are dealt to meet its result

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _run(start: Column, k: Column) -> Column:
    """The window of k words from a place on, and its hash key."""
    return F.slice("words", start + 1, k)


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(window, k, h, words of the window joined) and (window, item) of all items."""
    n = F.size("words")
    k = F.least(n, F.lit(width))
    rows = (
        items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("words"))
        .filter(n > 0)
        .select("item", "words", k.alias("k"), F.explode(F.sequence(F.lit(0), n - k)).alias("at"))
        .select("item", "k", F.xxhash64("k", _run(F.col("at"), F.col("k"))).alias("h"), F.concat_ws(" ", _run(F.col("at"), F.col("k"))).alias("run"))
        .distinct()
    )
    rows = stored(rows, "decon-items")
    known = stored(rows.select("k", "h", "run").distinct().withColumn("window", F.monotonically_increasing_id()), "decon-windows")
    return known, rows.join(known, ["k", "h", "run"]).select("window", "item")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document (key, id, n_words; at = -1) and one per hit (key, at, k, window) of each row's text."""
    lengths = sorted(r["k"] for r in known.select("k").distinct().collect()) or [width]  # at most ``width`` numbers
    size = known.agg(F.sum(F.octet_length("run") + ROW_BYTES)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("words"))
    n, few = F.size("words"), len(lengths)
    places = F.greatest(n - lengths[0] + 1, F.lit(0)) * few
    # one generator: the row's own mark, then every place with every length in use
    spread = texts.select("id", "key", "words", F.explode_outer(F.sequence(F.lit(-1), places - 1)).alias("q"))
    at, k = F.floor(F.col("q") / few).cast("int"), F.element_at(F.array(*map(F.lit, lengths)), F.pmod("q", F.lit(few)) + 1)
    spread = spread.select("id", "key", "words", F.when(F.col("q") < 0, -1).otherwise(at).alias("at"), (k if few > 1 else F.lit(lengths[0])).alias("k"))
    start = F.greatest("at", F.lit(0))
    spread = spread.withColumn("h", F.xxhash64("k", _run(start, F.col("k"))))
    out = None
    for b in range(blocks):
        part = known.filter(F.pmod("h", F.lit(blocks)) == b).select(F.col("h").alias("_h"), F.col("run").alias("_run"), "window")
        met = (F.col("h") == F.col("_h")) & (F.col("at") >= 0) & (F.concat_ws(" ", _run(start, F.col("k"))) == F.col("_run"))
        found = spread.join(F.broadcast(part), met, "left").filter(F.col("window").isNotNull() | ((F.col("at") < 0) & F.lit(b == 0)))
        mark = F.col("at") < 0
        found = found.select(
            "key", F.when(mark, F.col("id")).alias("id"), F.when(mark, n.cast("long")).alias("n_words"), "at", F.when(~mark, F.col("k")).alias("k"), "window"
        )
        out = found if out is None else out.union(found)
    return stored(out, "decon-scan")


def _hits(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("at") >= 0).select("key", "at", "k", "window").distinct()


def _reached(hits: DataFrame) -> DataFrame:
    """(key, at, to, before): the hit runs of a text in order, with the furthest end of the earlier ones."""
    earlier = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    runs = hits.groupBy("key", "at").agg(F.max(F.col("at") + F.col("k")).alias("to"))
    return runs.withColumn("before", F.coalesce(F.max("to").over(earlier), F.lit(0)))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    known, holders = windows(items, item_col, item_text_col, width)
    scanned = scan(docs, known, id_col, text_col, width)
    hits = _hits(scanned)
    covered = _reached(hits).groupBy("key").agg(F.sum(F.greatest(F.col("to") - F.greatest("at", "before"), F.lit(0)).cast("long")).alias("n_hit"))
    named = hits.select("key", "window").distinct().join(holders, "window").select("key", "item").distinct()
    named = named.groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("names"))
    # a text may stand on a third of all rows: its one result, some 100 bytes, is repeated so that they spread
    per_text = covered.join(named, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = scanned.filter(F.col("at") < 0).select("key", "id", "n_words", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("salt"))
    zero = F.lit(0).cast("long")
    return rows.join(per_text, ["key", "salt"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("names", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def spans(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH, **cols) -> DataFrame:
    """(key, spans): per hit text its merged spans of hit words, ends exclusive, in order."""
    known, _ = windows(items, cols.get("item_col", "item_id"), cols.get("item_text_col", "text"), width)
    reached = _reached(_hits(scan(docs.select(F.lit(0).alias("id"), text_col), known, "id", text_col, width)))
    island = F.sum(F.when(F.col("at") > F.col("before"), 1).otherwise(0)).over(Window.partitionBy("key").orderBy("at"))
    merged = reached.withColumn("island", island).groupBy("key", "island").agg(F.min("at").alias("start"), F.max("to").alias("stop"))
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def remove_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of an item."""
    found = spans(docs, items, text_col, **kw).select(F.col("key").alias("_decon_key"))
    return docs.join(found, text_key(F.col(text_col)) == F.col("_decon_key"), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """All rows of ``docs``, hit words cut out of their texts together with what stands before each of them."""
    found = spans(docs, items, text_col, **kw).select(F.col("key").alias("_decon_key"), F.col("spans").alias("_decon_spans"))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"[{BETWEEN}]*[^{BETWEEN}]+"), F.lit(0))
    joined = docs.join(found, text_key(F.col(text_col)) == F.col("_decon_key"), "left").withColumn("_decon_pieces", F.when(F.col("_decon_spans").isNotNull(), pieces))
    starts = F.concat(F.array(F.lit(0)), F.col("_decon_spans.stop"))
    stops = F.concat(F.col("_decon_spans.start"), F.array(F.size("_decon_pieces")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda g: F.array_join(F.slice("_decon_pieces", g["a"] + 1, g["b"] - g["a"]), ""))
    tail = F.regexp_extract(F.col(text_col), f"[{BETWEEN}]*$", 0)
    text = F.when(F.col("_decon_spans").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return joined.withColumn(text_col, text).select(*docs.columns)


ORACLE = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark
), s AS (
    SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0
), x AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(w[p : p + k - 1], ' ') AS run FROM s
), ks AS (SELECT DISTINCT k FROM x),
q AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
h AS (
    SELECT r, p, k, item FROM (SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS run FROM q) JOIN x USING (k, run)
), c AS (
    SELECT r, count(DISTINCT o) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS o FROM h) GROUP BY r
), i AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
