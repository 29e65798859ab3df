"""Rows told apart by id and text: repeated and missing ids through near duplicates, the token files and the pipeline."""

import numpy as np
from pyspark.sql import functions as F

from tickerloom.llm import jaccard, orc_tokens
from tickerloom.llm.queries import tokenizer_path

A = "one two three four five six seven eight nine ten"
B = "red green blue white black brown grey pink gold lime"
ROWS = [(1, A), (1, B), (2, A), (None, A), (None, A + " x"), (None, "lone words here"), (None, "lone words here"), (3, None), (3, ""), (None, " \n"), (1, A), (4, B.upper()), (5, "own text of this row")]


def test_representatives_by_row(spark):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, row int")
    got = sorted(((r.doc_id, r.text) for r in jaccard.representatives(docs).collect()), key=str)
    want = [(1, A), (1, B), (None, "lone words here"), (3, None), (3, ""), (None, " \n"), (5, "own text of this row")]
    assert got == sorted(want, key=str)
    assert jaccard.representatives(docs).columns == docs.columns
    assert jaccard.representatives(docs.limit(0)).count() == 0


def test_components_of_repeated_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=str)
    n = lambda t: max(0, len((t or "").split()) - 4) or min(1, len((t or "").split()))
    # A, A x and copies share component 1 by its least id, so do B and its copy; the row without id alone has none
    least = lambda i, t: i if not (t or "").split() else 1 if t.startswith("one") or t.lower() == B else None if t.startswith("lone") else i
    assert got == sorted(((i, n(t), least(i, t)) for i, t in ROWS), key=str)


def test_starts_with_limited_files(spark):
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    docs = spark.range(200).select((F.col("id") / 2).cast("long").alias("doc_id"), F.concat(F.lit("text of number "), "id").alias("text")).repartition(3)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        got = orc_tokens.round_trip(docs, tokenizer_path("word_bpe_49k.json")).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    sizes = [r.n_tokens for r in got]
    assert len(got) == 200 and [r.start for r in got] == [0, *np.cumsum(sizes)[:-1].tolist()]
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
