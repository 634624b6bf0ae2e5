"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents. The mixture may repeat a document, one row for each use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from quern.llm._shared import Scratch, documents


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, bpe.default_path())


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: SQL has no SimHash of XXH64 and no BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
