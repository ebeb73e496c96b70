"""The corpus pipeline: language, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``docs``, whatever else those hold, and read no other
column than they name. Every stage takes rows with a null key or text and repeated rows, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eigenfold.llm import language, packing, simhash, toxicity
from eigenfold.llm.common import checkpointed, fold, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents written in one of the languages learned from them; null, empty and letterless texts go."""
    return language.accepted(docs, language.train(docs, where=fold("doc_id", 5) != 0))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below the threshold, learned from the labels of those it has; a null text stays."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), where=fold("doc_id", 4) != 2))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest key; rows with a null key stay."""
    return simhash.representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows; repeated rows are packed as often as they occur, a null text is its end id."""
    return packing.packed(docs)


STAGES = [("language", language_stage), ("toxicity", toxicity_stage), ("simhash", simhash_stage), ("packing", packing_stage)]

#: None of the stages can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
