"""The queries op1-op13 and pipeline: thin forms of the operators with production parameters, and their SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.llm import align, blockmax, decontaminate, jaccard, lattice, lbl, mixing, omh, orc_tokens, pii, piece, toxicity, warc
from tickerloom.llm.common import bounded_batches, held_out, table


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprints(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("fault")


def op3_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score_documents(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 3).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


def op6_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return piece.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_statistics(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_omh, op2_warc, op3_lbl, op4_pii, op5_toxicity, op6_piece, op7_mixing, op8_jaccard, op9_orc, op10_lattice, op11_blockmax, op12_align, op13_decontaminate, pipeline)}
ORACLES = {"op2_warc": warc.ORACLE, "op7_mixing": mixing.ORACLE, "op11_blockmax": blockmax.ORACLE, "op13_decontaminate": decontaminate.ORACLE}
