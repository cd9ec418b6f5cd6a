"""Contiguous shards of equal bytes from global prefix sums.

Rows are ordered once by a range partitioning of their small columns; every partition's total is known from one
aggregation, the totals' running sum gives each partition its offset, and a running sum inside the partition completes
the prefix.  Texts are not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.durable import durable
from spanloom.functions.ranking import prefix_sums

#: Bytes that a row counts beside its text.
ROW_BYTES = 16


def text_bytes(column: Column) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def assign_shards(rows: DataFrame, shards: int, order: list[str], size: str = "size") -> DataFrame:
    """rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Cuts lie at equal targets of the global size: a row belongs to the shard in whose target range its middle falls, so
    shards are contiguous in ``order`` and differ from the target by less than one row's size.  ``size`` must not be
    null or negative; if all sizes are 0 every row goes to shard 0.  An empty table stays empty.
    """
    placed = durable(prefix_sums(rows, order, size), "placed")
    total = placed.agg(F.sum(size)).first()[0] or 0
    middle = (2 * F.col("before") + F.col(size)).cast("decimal(38,0)") * shards
    shard = F.least(F.floor(middle / F.lit(2 * total).cast("decimal(38,0)")), F.lit(shards - 1)) if total else F.lit(0)
    placed = placed.withColumn("shard", shard.cast("int")).drop("before")
    first = placed.groupBy("shard").agg(F.min("rank").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("_first")).drop("rank", "_first")


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for docs (doc_id, text): contiguous ranges of doc_id of equal bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus 16, so no row is free.  Null doc_ids come first; ties are
    ordered by text_crc32 and size, and rows equal in all of these in an arbitrary order.  Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (text_bytes(F.col("text")) + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return assign_shards(rows, shards, ["doc_id", "text_crc32", "size"])


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """Write whole documents as ``path``/shard=N, in slot order.  doc_id must be unique and not null."""
    placed = shard_documents(docs, shards).select("doc_id", "shard", "slot")
    (
        docs.join(placed, "doc_id")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
