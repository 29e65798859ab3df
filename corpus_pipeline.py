"""Documents to token digests in five stages, each writing a table that the next one reads.

toxicity: documents with a score of 0.7 or more go. near_duplicates: of each group of documents linked
by 5-word shingles at a Jaccard likeness of 0.75 or more the one with the smallest id stays. pii: personal
data is masked by its kind. mixing: each document stays as often as the mix of sources takes it (0, 1 or 2
times). tokens: the texts are encoded and decoded.

Null or empty texts are clean, stand alone and cost nothing; an empty table runs through all stages.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.llm import jaccard, mixing, pii, piece, toxicity
from tickerloom.llm.common import bounded_batches, shared_path, table
from tickerloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model, limit=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return piece.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("pii", mask_personal),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

# A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's table is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
