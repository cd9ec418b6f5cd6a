"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks of equal bytes.  The target is a fluid one: in every slot each source that still has blocks
gets its weight's share, so that after t slots source s should have had ``f(s, t)`` blocks, and all sources together t.
Block j of a source may start at the last slot t with ``f(s, t) <= j`` (its release) and must end by the first with
``f(s, t) >= j + 1`` (its deadline).  Earliest deadline first over these windows keeps every source within less than one
block of its target in every prefix of the schedule.

Which block goes first depends on all slots before, so the slots are found one after the other, by a fold over a row
that holds what each source has had.  The fold runs over one stretch of slots at a time; each stretch is written
to the shared folder and the next goes on from its last state.  The steps are as many as there are blocks of bytes, each
over the sources; all else (rows, windows, places) is done in parallel.  Everything is DataFrame functions, and the driver
holds a few sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.durable import durable, new_path
from spanloom.functions.ranking import prefix_sums
from spanloom.llm.sharding import text_bytes

#: Rows without a source are mixed as this one.
NO_SOURCE = ""

#: Slots that one fold plans before its result is written.
STRETCH = 8_192

#: Weights are whole numbers, of this size for the largest: a share is exact to 12 digits of the whole.
SCALE = 10**12

#: Blocks that a schedule has at most, about, if its blocks have no size of their own.
BLOCKS = 1 << 20

#: Planned blocks that may be broadcast to the rows: some dozen bytes each.  More are joined through a shuffle.
BROADCAST_BLOCKS = 500_000

def whole_weights(sources: DataFrame, least: int) -> DataFrame:
    """sources (source, blocks, weight) with ``w``, the weight as a whole number.

    Weights need not sum to one.  Weights that are null, zero, negative, infinite or no number count as the smallest
    share, 1 / least of the sum of the others; if there are no others, all are equal.
    """
    good = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    top = sources.agg(F.max(F.when(good, F.col("weight")))).first()[0] or 1.0
    named = sources.withColumn("w", F.when(good, F.greatest(F.round(F.col("weight") / top * SCALE), F.lit(1.0)).cast("long")))
    others = named.agg(F.sum("w")).first()[0] or least
    return named.withColumn("w", F.coalesce("w", F.lit(max(1, others // least))))


def _times(a: Column, b: Column) -> Column:
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def _div(a: Column, b: Column) -> Column:
    """The whole part of a quotient of whole numbers, exact up to 38 digits."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))


def _div_up(a: Column, b: Column) -> Column:
    return _div(a.cast("decimal(38,0)") + b - 1, b)


def virtual_time(blocks: Column) -> Column:
    """When a source of weight ``w`` has had so many blocks in the fluid target: blocks / w, to 26 digits."""
    return (blocks.cast("decimal(12,0)") / F.col("w").cast("decimal(13,0)")).cast("decimal(38,26)")


def lives(sources: DataFrame, slots: int, total: int) -> DataFrame:
    """sources (source, blocks, w) with their ``life``, the virtual time at which their blocks are done; ``done``, the blocks
    of sources that end before; ``share``, the weights of the others; and ``end``, the first slot by which the source is done."""
    life = virtual_time(F.col("blocks")).alias("life")
    ordered = prefix_sums(sources.select("source", "blocks", "w", life), ["life", "source"], "blocks").drop("rank").withColumnRenamed("before", "done")
    ordered = prefix_sums(ordered, ["life", "source"], "w").drop("rank").withColumn("share", F.lit(total) - F.col("before"))
    end = F.col("done") + _div_up(_times(F.col("share"), F.col("blocks")), F.col("w"))
    return ordered.withColumn("end", F.least(end, F.lit(slots)).cast("long")).drop("before")


def plan(sources: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(source, block, release, deadline, slot) for sources (source, blocks, w): all blocks in slots from 0 without gaps.

    When a source runs out, the others go on by their weights: the target is that of the sources that still have blocks.
    Equal deadlines go by the name of the source; deadlines are compared in double precision, releases exactly.
    """
    spark = sources.sparkSession
    sources = sources.where("blocks > 0")
    slots, total = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    own = durable(lives(sources, slots, total), "lives")
    entry = F.struct("source", "blocks", "w", "end", "life", "done", "share")
    state = own.agg(F.array_sort(F.collect_list(entry)).alias("sources")).select(
        "sources", F.transform("sources", lambda x: F.lit(0).cast("long")).alias("had"),
        F.struct(F.lit(0).cast("long").alias("done"), F.lit(total).cast("long").alias("share"), F.array_min(F.transform("sources", lambda x: x["end"])).alias("until")).alias("live"),
    )
    path = new_path(spark, "schedule")
    state.select(F.lit(0).cast("long").alias("upto"), "sources", "had", "live", F.array().cast("array<struct<slot:bigint,i:int,block:bigint>>").alias("out")).write.parquet(f"{path}/0")
    at, done = 0, [f"{path}/0"]
    while at < slots:
        until = min(at + stretch, slots)
        folded = spark.read.parquet(done[-1]).select("sources", _fold(F.lit(at), F.lit(until)).alias("f"))
        done.append(f"{path}/{until}")
        folded.select(F.lit(until).cast("long").alias("upto"), "sources", "f.had", "f.live", "f.out").write.parquet(done[-1])
        at = until
    slot = spark.read.parquet(*done).select("sources", F.explode("out").alias("x")).select("sources", F.get("sources", F.col("x.i")).alias("own"), "x.block", "x.slot")
    return _windows(slot.select("sources", "own.source", "own.w", "block", "slot"))


def _fold(at: Column, until: Column) -> Column:
    """struct<had, live, out> after the slots from ``at``: in each the released block with the earliest deadline goes."""
    sources = F.col("sources")
    out = F.array().cast("array<struct<slot:bigint,i:int,block:bigint>>")
    start = F.struct(F.col("had").alias("had"), F.col("live").alias("live"), out.alias("out"))

    def renewed(t: Column) -> Column:
        """What holds from the end of a source on."""
        alive, over = F.filter(sources, lambda x: x["end"] > t), F.filter(sources, lambda x: x["end"] <= t)
        sum_of = lambda xs, c: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x[c])
        return F.struct(sum_of(over, "blocks").alias("done"), sum_of(alive, "w").alias("share"), F.array_min(F.transform(alive, lambda x: x["end"])).alias("until"))

    def released(x: Column, had: Column, t: Column, live: Column) -> Column:
        """Whether the fluid target at t is over what the source has had."""
        due, got = x["w"].cast("double") * (t - live["done"]), had.cast("double") * live["share"]
        exact = _times(x["w"], t - live["done"]) > _times(had, live["share"])
        return F.when(x["end"] <= t, True).when(due > got * (1 + 1e-12), True).when(due < got * (1 - 1e-12), False).otherwise(exact)

    def bound(value: Column, f) -> Column:
        """f of a value that is computed once."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def slot(state: Column, t: Column) -> Column:
        after = t + 1
        live = F.when(after >= state["live"]["until"], renewed(after)).otherwise(state["live"])

        def with_live(now: Column) -> Column:
            index = F.sequence(F.lit(0), F.size(sources) - 1)
            able = lambda i, x, c: F.when((c < x["blocks"]) & released(x, c, after, now), F.struct(((c + 1) / x["w"].cast("double")).alias("deadline"), i.alias("i")))
            jobs = F.transform(F.arrays_zip(index.alias("i"), sources.alias("x"), state["had"].alias("c")), lambda z: able(z["i"], z["x"], z["c"]))
            return bound(F.array_min(jobs), lambda job: taken(job["i"], now))

        def taken(i: Column, now: Column) -> Column:
            done = F.struct(t.cast("long").alias("slot"), i.cast("int").alias("i"), F.get(state["had"], i).alias("block"))
            had = F.transform(state["had"], lambda c, k: F.when(k == i, c + 1).otherwise(c))
            return F.struct(had.alias("had"), now.alias("live"), F.concat(state["out"], F.array(done)).alias("out"))

        return bound(live, with_live)

    return F.aggregate(F.sequence(at.cast("long"), until.cast("long") - 1), start, slot)


def _windows(slots: DataFrame) -> DataFrame:
    """slots (sources, source, w, block, slot) with ``release`` and ``deadline`` in place of ``sources`` and ``w``.

    Between the ends of two sources, slot and virtual time are in proportion: the pieces are as many as the sources.
    """

    def at(block: Column, up: bool) -> Column:
        left = F.filter("sources", lambda x: x["life"] >= virtual_time(block))
        piece = F.array_min(F.transform(left, lambda x: F.struct(x["life"], x["source"], x["done"].alias("done"), x["share"].alias("share"))))
        whole = _div_up if up else _div
        return F.get(F.transform(F.array(piece), lambda x: x["done"] + whole(_times(block, x["share"]), F.col("w"))), F.lit(0))

    return durable(slots.select("source", "block", at(F.col("block"), False).alias("release"), at(F.col("block") + 1, True).alias("deadline"), "slot"), "plan")


def schedule(
    docs: DataFrame, weights: DataFrame | None = None, block_bytes: int | None = None, least: int = 1_000, power: float = 0.5, stretch: int = STRETCH
) -> DataFrame:
    """(doc_id, source, size, block, release, deadline, slot, place) for all rows of docs (doc_id, source, text).

    Blocks have ``block_bytes`` bytes; without it, a BLOCKS-th of all bytes, and 64 KiB at least.

    ``slot`` is the block's place in the mixed order and ``place`` the row's place in its block.  weights (source,
    weight) are the targets; sources without one get the smallest share (see ``whole_weights``).  Without ``weights``,
    a source's target is its bytes to the ``power`` of 0.5, which lifts small sources.  A source's rows are taken in the
    order of a hash of doc_id, and a row belongs to the block in which its middle byte falls (size: UTF-8 bytes and 16).
    All rows are kept: none is dropped or repeated (see ``plan`` for sources that run out); slots are numbered from 0
    without gaps, but a slot whose block has no row's middle has no row.  Null sources are one source of their own (the
    empty name).  Rows that are equal in doc_id, source and size are ranked arbitrarily.  An empty table stays empty.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"),
        (text_bytes(F.col("text")) + 16).alias("size"), F.xxhash64("doc_id").alias("draw"),
    )
    placed = prefix_sums(rows, ["source", "draw", "doc_id", "size"], "size", within=["source"])
    block_bytes = block_bytes or max(65_536, (rows.agg(F.sum("size")).first()[0] or 0) // BLOCKS)
    placed = durable(placed.withColumn("block", F.floor((F.col("before") + F.col("size") / 2) / block_bytes).cast("long")), "placed")
    own = placed.groupBy("source").agg(F.sum("size").cast("double").alias("bytes"), (F.max("block") + 1).alias("blocks"))
    if weights is None:
        target = own.select("source", "blocks", F.pow("bytes", F.lit(power)).alias("weight"))
    else:
        given = weights.where("source is not null").groupBy("source").agg(F.max(F.col("weight").cast("double")).alias("weight"))
        target = own.join(given, "source", "left").select("source", "blocks", "weight")
    planned = plan(durable(whole_weights(target, least), "sources"), stretch)
    first = Window.partitionBy("source", "block").orderBy("rank")
    place = (F.row_number().over(first) - 1).cast("long").alias("place")
    return placed.join(F.broadcast(planned) if planned.count() <= BROADCAST_BLOCKS else planned, ["source", "block"]).select(
        "doc_id", "source", "size", "block", "release", "deadline", "slot", place
    )
