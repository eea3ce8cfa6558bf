"""A corpus made ready for training: clean documents, one of each group of near copies, without passages that repeat, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import packing, quality, simhash, storage, suffix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, storage.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs.select(COLUMNS), model).where("score >= 0.5").select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by near copies (five-word shingles, Jaccard similarity of 0.8 or more) the one with the smallest id."""
    return simhash.without_near_duplicates(docs.select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur more than once, the first occurrence included; ``n_chars`` follows.
    A document that nothing is left of stays, with an empty text."""
    cut = suffix.remove_repeats(docs, with_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each_group), ("repeats", cut_repeats), ("packing", pack)]

#: No SQL can say the same as a trained network or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next begins."""
    docs = storage.table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = storage.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
