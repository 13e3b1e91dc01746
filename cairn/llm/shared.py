"""Small Spark helpers for this subpackage, and the shared-folder tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import materialize, shared_dir

__all__ = ["aside", "bounded_batches", "fresh", "lower_ascii", "materialize", "shared_dir", "table"]

#: Rows and bytes that one Arrow batch may hold; texts of a batch are further sliced by bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text):
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as keep it apart from columns (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def aside(docs: DataFrame, made: list[str]):
    """(docs with columns of the names in `made` out of the way, a function that selects the columns of docs again)."""
    taken = {m.lower() for m in made}
    moved: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in taken:
            moved[c] = fresh("_" + c, [*docs.columns, *made, *moved.values()])
    columns = list(docs.columns)
    return docs.withColumnsRenamed(moved), lambda out: out.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in columns])
