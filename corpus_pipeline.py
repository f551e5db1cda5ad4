"""The corpus pipeline: language ID, near-duplicates, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import langid, lshforest, packing, surrogates
from loglattice.llm.catalog import PIECES, SURROGATE_KEY, WORD_BPE
from loglattice.llm.common import checkpoint, remainder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, with the predicted one in `lang`. Rejected: texts that are null or have no
    letter, and texts mostly of letters that their language never showed."""
    model = langid.train(docs.where(remainder("doc_id", 4) != 2), PIECES)
    got = langid.predict(docs, model, lang="_lang", score="_score")
    return got.where(langid.accepted("_lang", "_score")).withColumn("lang", F.col("_lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: the one with the smallest doc_id."""
    return lshforest.deduplicate(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates in its text and n_chars to match."""
    key = surrogates.checked_key(docs, SURROGATE_KEY)
    got = surrogates.replace(docs, key, spans=None)
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; every token of every document in one of them."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", pack)]

#: Stages hold a trained model, a hash forest, keyed permutations and a tokenizer: SQL has no form of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
