"""Ranks and running sums over whole tables: no task sees more than its own range of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.durable import durable


def prefix_sums(
    df: DataFrame, order: list[str], value: str, within: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """df with ``before`` (the sum of ``value`` in all rows ordered before) and ``rank`` (their number, from 0).

    ``within``: columns, a prefix of ``order``, in whose groups the sums start anew.  One group may hold any share of
    the rows: a group spans partitions.  Rows that are equal in all ``order`` columns are dealt over partitions as
    well and ranked in a fixed but arbitrary order.  The ordered rows are written to the shared folder once, so a
    partition's rows and totals always agree, whatever executors are lost.
    """
    within = within or []
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*order, "_tie"]
    dealt = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *order)
    rows = durable(dealt.withColumn("_part", F.spark_partition_id()), "ordered")
    totals = rows.groupBy(*within, "_part").agg(F.sum(value).alias("_sum"), F.count("*").alias("_count"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *within, "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum"),
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_count"),
    )
    running = Window.partitionBy("_part", *within).orderBy(*order)
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_at", F.row_number().over(running) - 1)
    same = [own[c].eqNullSafe(offsets[c]) for c in within]
    joined = own.join(offsets, [own["_part"] == offsets["_part"], *same])
    return joined.select(
        *[own[c] for c in df.columns],
        (own["_own"] + offsets["_sum"]).cast("long").alias("before"),
        (own["_at"] + offsets["_count"]).cast("long").alias("rank"),
    )


def ranked(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df with each row's place in a given order, from 0 without gaps; ties in a fixed but arbitrary order."""
    return prefix_sums(df.withColumn("_one", F.lit(1)), order, "_one").drop("_one", "before").withColumnRenamed("rank", name)
