"""A corpus pipeline of five of the operators, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import decontam, line_dedup, near_dup, packing, quality
from kbspark.llm.queries import vocabulary
from kbspark.llm.shared import written
from kbspark.sources.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; rejected ones go."""
    return quality.keep_good_documents(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the boilerplate lines of its source; n_chars follows the text."""
    cut = line_dedup.drop_boilerplate_lines(docs, counts=False)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least id."""
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ranges of all documents in padded batches."""
    return packing.pack(docs, packing.token_counts(vocabulary())(F.col("text")))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_dedup", one_of_each),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
#: No SQL: the classifier, MinHash, seed and packing stages can't be stated in it; tests hold run() against
#: the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
