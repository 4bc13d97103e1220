"""Pipeline over ``documents``: rules, exact dedup, near dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sprintlens.llm import exact_dedup, mixture, packing, quality_rules, simhash
from sprintlens.llm.common import Scratch, passing


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", _quality_rules),
    ("exact_dedup", _exact_dedup),
    ("near_dedup", _near_dedup),
    ("mixture", _mixture),
    ("packing", _packing),
]

#: XXH64 fingerprints and tokenization have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each over all that the one before it kept; a stage's tables go when the next ones are whole."""
    at, last = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with passing():
            docs = at.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if last is not None:
            at.delete(last)
        last = f"{k}-{name}"
    return docs
