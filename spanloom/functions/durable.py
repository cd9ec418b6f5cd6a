"""Intermediate tables that outlive executors.

Work that must be read twice, or whose lineage is too costly to run again, is written as Parquet below the
cluster's shared folder ``spark.checkpoint.dir`` and read back.  Nothing is kept on one executor's disk, so a lost
executor costs a re-read and never a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    On one machine (a local master) a fresh local folder is named where the setting is unset, for tests and benchmarks;
    on a cluster an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: The paths that the innermost scope will delete.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that were written inside, once the block has ended without an error.

    Results are lazy and read those tables: write or collect them inside the block.  After an error the tables stay, for
    whoever looks for its cause.  Scopes may be nested; an inner one deletes its own tables only.
    """
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
    for path in paths:
        delete_path(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other table uses."""
    path = f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, and every later reader sees equal rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path through the file system that owns it (the store may be one that only Spark can open)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
