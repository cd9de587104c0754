"""The shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local-mode session without the setting gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder is lost
    with its executor.
    """
    configured = spark.conf.get(_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="pairlens-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that run within the block delete their shuffle files at their end, not at some later garbage collection."""
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage for inputs used by several outputs; the written table outlives
    lost executors. The disk holds the shuffles of one such step at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing will read them any more."""
    for df in written:
        path = df.__dict__.get("_written_to")
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over ``spark.sql.shuffle.partitions`` tasks, by the columns or evenly.

    For narrow rows that are about to be multiplied or to meet costly expressions:
    adaptive execution would pack them into few tasks by their present size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)
