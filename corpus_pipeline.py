"""Corpus preparation over `documents`: quality rules, near-duplicate removal, benchmark
decontamination, mixing sources to target weights, sharding.

Each stage takes all rows its predecessor kept, and returns the columns of `documents` with their own
values, whatever other columns the table has; the last adds where each row goes and replaces columns
of those names. Texts are taken whole at any length.

Null, empty and blank texts have fewer than ten words, so they go at the first stage. Null doc_ids
and sources are ordinary rows. Rows that repeat a doc_id and text are alike at every stage and stay
together: of a group of near-duplicates all rows of the smallest doc_id stay. An empty table runs
through and gives an empty result. Near-duplicate and mixing stages can't be expressed in SQL together
(groups are connected components), so ORACLE_SQL is None and the tests compare with a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.decontam import clean_documents
from cairn.llm.mixing import training_order
from cairn.llm.near_dedup import near_duplicates
from cairn.llm.quality import good_documents
from cairn.llm.shared import materialize
from cairn.llm.sharding import shard_documents

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    dropped = near_duplicates(docs, k=5, percent=80, rows=5).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return clean_documents(docs, items)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order."""
    return training_order(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with size, text_crc32, shard, slot."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
