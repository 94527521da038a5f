"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import bpe, decontaminate, line_runs, simhash, texts, toxicity
from scanloom.llm.queries import rank_file


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.without_toxic(docs, texts.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out of the texts."""
    return line_runs.without_later_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.without_contaminated(docs, texts.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document that is left."""
    return bpe.digests(docs, *rank_file())


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", contamination), ("bpe", tokens)]
#: No stage can be written in SQL; tests/llm checks the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = texts.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
