"""How much data one Arrow batch may carry to a Python worker, and how many rows one task should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes and rows of a batch of texts.  The JVM and the worker hold a few batches for every running task.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4_000


def small_batches(spark: SparkSession) -> None:
    """Lower this session's Arrow batch limits to BATCH_BYTES and BATCH_ROWS, if they are higher or unlimited.

    Whole texts have no common length: Spark's limit of 10,000 rows alone can mean gigabytes in a batch.
    """
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


#: Rows that a task sorts or holds in a hash table: some hundred bytes each.
TASK_ROWS = 500_000


def dealt(key: str, *frames: DataFrame, rows: int = TASK_ROWS) -> list[DataFrame]:
    """Tables dealt out by a column they share, to as many tasks as the first one's rows call for.

    Their joins and groups by that column need no other shuffle.  A fixed number of partitions would give each task more memory
    to hold with every row of input.
    """
    least = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-frames[0].count() // rows))
    return [x.repartition(parts, key) for x in frames]
