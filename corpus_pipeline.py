"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, decontamination and source mixing, in this order.

Each stage works on the whole of what its predecessor kept; :func:`run` writes each stage's result to the folder that all executors
share and reads it again, so a lost executor costs no more than its tasks. The first four stages return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import common, decontaminate, fertility, jaccard, lines, mixing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility bands of their language or script keep."""
    return fertility.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that occur before, exactly or nearly; n_chars follows the text."""
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of similar ones."""
    return jaccard.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks chosen to meet the sources' target weights, by document: doc_id, source, shard, block, n_tokens."""
    return mixing.mix(docs).drop("_digest", "_len")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
]
#: SQL can't express the tokeniser, SimHash and edit-distance stages; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
