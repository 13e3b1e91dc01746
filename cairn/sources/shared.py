"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of the context. Only a local session without either uses its own temp folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or f"{tempfile.gettempdir()}/spark-checkpoints").rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def plain_path(path: str) -> str | None:
    """The path as Python opens it, in tasks too; None if only Spark's readers can, or if it is a pattern."""
    at = urlparse(path)
    if at.scheme not in ("", "file") or any(c in path for c in "*?[{"):
        return None
    return unquote(at.path) if at.scheme else path


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors. The application's tables go when it ends."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    application = path.rsplit("/", 1)[0]
    if application not in _marked:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        _marked.add(application)
    return spark.read.schema(df.schema).parquet(path)
