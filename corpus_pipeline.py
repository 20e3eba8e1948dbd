"""Corpus pipeline: toxicity, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents; the last one returns pieces of sequences.
"""
from pyspark.sql import DataFrame, SparkSession

from shotweave.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from shotweave.llm.frames import tokenizer_path, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs.select(COLUMNS), toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id."""
    return exact_dedup.keep_one(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, 0.8 or more); empty texts stay, as they are linked with nothing."""
    return near_dedup.keep_one(docs.select(COLUMNS))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that an earlier document has; n_chars counts what is left."""
    return suffix_dedup.without_passages(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", clean_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_passages), ("packing", pack_sequences)]
#: The learnt weights of the first stage and the tokenizer of the last have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
