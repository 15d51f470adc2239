"""A corpus pipeline of five stages: quality rules, near-dedup, personal data, mixing, packing.

Every stage gives an empty table for an empty table; all but the last keep the columns of documents,
extra ones among them, whatever their names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sparkgauge.llm.common import delete, scratch, tables_in
from sparkgauge.llm.minhash import keep_representatives
from sparkgauge.llm.mixing import mix
from sparkgauge.llm.packing import pack_documents
from sparkgauge.llm.pii import redact
from sparkgauge.llm.quality_rules import keep_good


_held: list[str] = []


def frees_its_tables(stage):
    """The stage's scratch tables go into one folder, deleted when the next stage begins: by then the stage's result is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _held:
            delete(spark, _held.pop())
        _held.append(scratch(spark, stage.__name__))
        with tables_in(_held[-1]):
            return stage(spark, docs, sf_dir)

    return run


@frees_its_tables
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; rows are judged one by one, whatever their ids."""
    return keep_good(docs)


@frees_its_tables
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    Empty and null texts link with nothing and stay; of rows with equal texts one stays.
    """
    return keep_representatives(docs, width=5)


@frees_its_tables
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows the text; null texts stay null."""
    return redact(docs)


@frees_its_tables
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the order, as the mix takes them; null sources are one source, null and empty texts are in no mix."""
    return mix(docs)


@frees_its_tables
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; a null text is its end id alone, repeated ids keep rows of their own."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: EM, MinHash and tokenizers are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
