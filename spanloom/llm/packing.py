"""Best-fit packing under conflicts: a bin never holds two pieces of one source or of one duplicate cluster.

Bins are kept in the order of their residual capacity, each with a bitmap of its sources and clusters.  A piece goes to
the tightest bin that fits and doesn't conflict: the search starts at the smallest sufficient residual and moves to the
successor until the bitmaps have nothing in common.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.batches import small_batches
from spanloom.functions.durable import durable
from spanloom.functions.ranking import prefix_sums
from spanloom.llm.sharding import text_bytes


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in the bin) for pieces in the given order; masks hold the bits of a piece's source and cluster."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    bits: list[int] = []
    out = []
    for size, mask in zip(sizes, masks, strict=True):
        i = bisect_left(order, (size, -1))
        while i < len(order) and bits[order[i][1]] & mask:
            i += 1
        if i < len(order):
            residual, b = order.pop(i)
        else:
            residual, b = capacity, len(bits)
            bits.append(0)
        out.append((b, capacity - residual))
        bits[b] |= mask
        if residual > size:
            insort(order, (residual - size, b))
    return out


def _masks(names: list[list]) -> list[int]:
    """A bit for each source and for each cluster; names are (kind, value) pairs, of which a null value conflicts with nothing."""
    place: dict = {}
    out = []
    for own in names:
        mask = 0
        for kind, value in own:
            if value is not None:
                mask |= 1 << place.setdefault((kind, value), len(place))
        out.append(mask)
    return out


def _slot_groups(pieces: DataFrame, group_rows: int, stretch: int) -> DataFrame:
    """pieces (doc_id, piece, slot) with ``group``: groups of about ``group_rows`` in each run of ``stretch`` slots.

    Groups are numbered in the order of the runs, so group after group follows the mixed order.
    """
    run = F.floor(F.col("slot") / stretch).cast("long")
    runs = pieces.groupBy(run.alias("_run")).agg(F.ceil(F.count("*") / group_rows).cast("long").alias("_groups"))
    runs = durable(prefix_sums(runs, ["_run"], "_groups").select("_run", "_groups", F.col("before").alias("_first")), "runs")
    dealt = pieces.withColumn("_run", run).join(runs, "_run")
    return dealt.withColumn("group", F.col("_first") + F.pmod(F.xxhash64("doc_id", "piece"), F.col("_groups"))).drop("_run", "_groups", "_first")


def pack(pieces: DataFrame, capacity: int, group_rows: int = 2048, stretch: int | None = None, rounds: int = 1) -> DataFrame:
    """(doc_id, piece, size, group, bin, offset) for pieces (doc_id, piece, size, source, cluster).

    With ``stretch``, pieces have a ``slot`` as well, which the result keeps, and no group has pieces of more than one
    run of that many slots: groups are then in the order of the slots, and their mixture is that of the slots.

    Pieces are dealt by hash into groups of about ``group_rows``, and each group is packed by itself, largest piece
    first (ties by doc_id and piece), so that groups are independent, bounded units of work, and a hot source or cluster
    is spread evenly over them.  Without ``stretch``, bins that are not full then meet those of other groups ``rounds``
    times: a bin is packed like one large piece, with all its sources and clusters, and what goes into one bin takes
    the name of the first of them.  No size may exceed ``capacity``; pieces of size 0 or null are packed as size 0.
    Null sources and clusters conflict with nothing.  Repeated rows are packed each.  An empty table stays empty.
    """
    small_batches(pieces.sparkSession)
    names = ["doc_id", "piece", "size", "source", "cluster", *(["slot"] if stretch else [])]
    dealt = pieces.select(*names).withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    if stretch:
        dealt = _slot_groups(dealt, group_rows, stretch)
    else:
        groups = max(1, -(-pieces.count() // group_rows))
        dealt = dealt.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    again = rounds if not stretch else 0
    kinds = COLUMNS | ({"slot": pa.int64()} if stretch else {}) | ({"source": pa.string(), "cluster": pa.int64()} if again else {})

    def finish(rows: list[dict]) -> list[dict]:
        rows.sort(key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"]))
        placed = best_fit([r["size"] for r in rows], _masks([[("s", r["source"]), ("c", r["cluster"])] for r in rows]), capacity)
        return [r | {"bin": b, "offset": at} for r, (b, at) in zip(rows, placed, strict=True)]

    schema = "doc_id long, piece int, size long, group long, bin long, offset long" + (", slot long" if stretch else "") + (", source string, cluster long" if again else "")
    packed = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_by_group(finish, kinds), schema)
    for k in range(again):
        packed = _merge_bins(durable(packed, "packed"), capacity, group_rows, k)
    return packed.drop("source", "cluster") if again else packed


def _by_group(finish: Callable[[list[dict]], list[dict]], kinds: dict) -> Callable:
    """A map over Arrow batches sorted by ``group``: each group's rows through ``finish``, with the columns ``kinds``."""

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and r["group"] != held[0]["group"]:
                    out += finish(held)
                    held = []
                held.append(r)
            yield _batch(out, kinds)
        if held:
            yield _batch(finish(held), kinds)

    return run


def _merge_bins(packed: DataFrame, capacity: int, group_rows: int, salt: int) -> DataFrame:
    """packed with bins that are not full put together across groups."""
    bins = packed.groupBy(F.col("group").alias("from"), "bin").agg(F.sum("size").alias("size"), F.collect_set("source").alias("sources"), F.collect_set("cluster").alias("clusters"))
    bins = durable(bins.where(F.col("size") < capacity), "bins")
    groups = max(1, -(-bins.count() // group_rows))
    dealt = bins.withColumn("group", F.pmod(F.xxhash64("from", "bin", F.lit(salt)), F.lit(groups)))

    def finish(rows: list[dict]) -> list[dict]:
        rows.sort(key=lambda r: (-r["size"], r["from"], r["bin"]))
        masks = _masks([[*(("s", x) for x in r["sources"]), *(("c", x) for x in r["clusters"])] for r in rows])
        placed, first, out = best_fit([r["size"] for r in rows], masks, capacity), {}, []
        for r, (b, at) in zip(rows, placed, strict=True):
            first.setdefault(b, r)
            out.append({"from": r["from"], "bin": r["bin"], "to_group": first[b]["from"], "to_bin": first[b]["bin"], "shift": at})
        return out

    kinds = dict.fromkeys(("from", "bin", "to_group", "to_bin", "shift"), pa.int64())
    moved = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_by_group(finish, kinds), "from long, bin long, to_group long, to_bin long, shift long")
    moved = moved.where("shift > 0 or to_group <> from or to_bin <> bin").withColumnsRenamed({"from": "group"})
    joined = packed.join(moved, ["group", "bin"], "left")
    return joined.select(
        "doc_id", "piece", "size", F.coalesce("to_group", "group").alias("group"), F.coalesce("to_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), "source", "cluster"
    )


COLUMNS = {"doc_id": pa.int64(), "piece": pa.int32(), "size": pa.int64(), "group": pa.int64(), "bin": pa.int64(), "offset": pa.int64()}


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in kinds.items()], list(kinds))


def document_pieces(docs: DataFrame, capacity: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, size, source, cluster, *keep): whole documents as pieces of at most ``capacity`` bytes.

    A document of more bytes than a bin becomes full pieces and a last one.  Equal texts are one cluster.  A null or
    empty text is one piece of size 0 without a cluster.
    """
    size = text_bytes(F.col("text"))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int")
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.col("source").cast("string").alias("source"),
            F.when(size > 0, F.xxhash64("text")).alias("cluster"), *keep,
        )
        .withColumn("last", last)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("size", F.when(F.col("piece") < F.col("last"), capacity).otherwise(F.col("size") - F.col("last") * capacity).cast("long"))
        .select("doc_id", "piece", "size", "source", "cluster", *keep)
    )


def pack_documents(docs: DataFrame, capacity: int = 16_384, group_rows: int = 2048) -> DataFrame:
    """The pieces of all documents (doc_id, text, source) in bins of ``capacity`` bytes."""
    return pack(document_pieces(docs, capacity), capacity, group_rows)


def pack_mixed(docs: DataFrame, capacity: int = 16_384, group_rows: int = 2048, stretch: int = 64) -> DataFrame:
    """The pieces of all documents (doc_id, text, source, slot), with their slots, in bins within runs of ``stretch`` slots."""
    return pack(document_pieces(docs, capacity, ("slot",)), capacity, group_rows, stretch)
