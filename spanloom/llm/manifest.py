"""Merkle manifest of a table: a tree over each source's rows, a tree over the sources' roots, and a proof for each row.

Rows are placed by prefix sums, and runs of ``arity ** height`` neighbouring nodes of one tree are a block.  Executors
reduce every block to one node, round after round, until so few nodes are left that the driver may hold them.  It builds
the top of the trees and broadcasts, for each node it was given, the siblings on its way to the root; executors walk their
blocks once more and append the rest of the way.  One source may hold any share of the rows: blocks have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce as fold_left
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.durable import durable
from spanloom.functions.ranking import prefix_sums, ranked

#: The columns of a row that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, levels that a block covers, and nodes that the driver may hold (with some 2 KiB of siblings each).
ARITY, HEIGHT, TOP = 3, 7, 4_096

Way = tuple[list[str], list[str]]


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row: every field as ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text.

    ``changed`` gives other columns for some of the fields.
    """
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its siblings on either side, level by level, lead to."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof_text(left: Column, right: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b))), "")


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], arity: int) -> list[list[str]]:
    """The nodes and all levels above them, up to a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_hash(low[i : i + arity]) for i in range(0, len(low), arity)])
    return levels


def _way(levels: list[list[str]], at: int, arity: int) -> Way:
    """The siblings left and right of node ``at`` and of the nodes above it, a text for each level."""
    left, right = [], []
    for low in levels[:-1]:
        run = at - at % arity
        left.append("".join(low[run:at]))
        right.append("".join(low[at + 1 : run + arity]))
        at //= arity
    return left, right


def _raised(nodes: list[str], level: list[int], base: int) -> tuple[list[str], list[int]]:
    """Nodes of one tree brought to one level (a last block that is short ends below it), and the levels each rose by."""
    rise = [base - x for x in level]
    return [fold_left(lambda h, _: _hash([h]), range(n), h) for h, n in zip(nodes, rise, strict=True)], rise


def _block(table: pa.Table, base: int, arity: int) -> tuple[pa.Table, list[list[str]], list[int]]:
    """(nodes of a block in order, levels, levels each rose by); a tree's only node stays where it is."""
    table = table.sort_by("_pos")
    nodes, level = table["_node"].to_pylist(), table["_level"].to_pylist()
    alone = len(nodes) == 1 and table["_block"][0].as_py() == 0
    nodes, rise = (nodes, [0]) if alone else _raised(nodes, level, base)
    return table, _levels(nodes, arity), rise


def _upper(nodes: DataFrame, base: int, arity: int) -> DataFrame:
    """(_tree, _pos, _node, _level): each block of nodes as one node."""

    def one(table: pa.Table) -> pa.Table:
        table, levels, rise = _block(table, base, arity)
        level = table["_level"][0].as_py() + rise[0] + len(levels) - 1
        return pa.table({"_tree": table["_tree"][:1], "_pos": table["_block"][:1], "_node": pa.array([levels[-1][0]], pa.string()), "_level": pa.array([level], pa.int32())})

    return nodes.select("_tree", "_block", "_pos", "_node", "_level").groupBy("_tree", "_block").applyInArrow(one, "_tree string, _pos long, _node string, _level int")


def _top(rows: list, base: int, arity: int) -> dict[tuple[str, int], tuple[str, str, list[str], list[str]]]:
    """{(tree, pos): (subroot, root, left, right)} for a few nodes of all trees."""
    trees = {t: list(own) for t, own in groupby(sorted(rows, key=lambda r: (r["_tree"].encode(), r["_pos"])), key=lambda r: r["_tree"])}
    below = {}
    for t, own in trees.items():
        nodes = [r["_node"] for r in own]
        nodes, rise = _raised(nodes, [r["_level"] for r in own], base) if len(own) > 1 else (nodes, [0])
        below[t] = _levels(nodes, arity), rise
    above = _levels([levels[-1][0] for levels, _ in below.values()], arity)
    out = {}
    for k, (t, (levels, rise)) in enumerate(below.items()):
        over = _way(above, k, arity)
        for i, r in enumerate(trees[t]):
            left, right = _way(levels, i, arity)
            lift = [""] * rise[i]
            out[t, r["_pos"]] = levels[-1][0], above[-1][0], [*lift, *left, *over[0]], [*lift, *right, *over[1]]
    return out


_WAY = "_subroot string, _root string, _left array<string>, _right array<string>"


def _ways(nodes: DataFrame, base: int, arity: int, height: int, top: int) -> dict | DataFrame:
    """The way to the root from each node (_tree, _pos, _node, _level): a dict if the driver may hold it, else a table."""
    total, trees = nodes.count(), nodes.where("_pos = 0").count()
    if total <= top:
        return _top(nodes.collect(), base, arity)
    if total > trees:
        nodes = nodes.withColumn("_block", F.floor(F.col("_pos") / arity**height).cast("long"))
        above = _ways(durable(_upper(nodes, base, arity), "nodes"), base + height, arity, height, top)
        return durable(_walk(nodes, above, base, arity, ["_tree", "_pos"]), "ways")
    # more trees than the driver may hold: their roots are the leaves of one tree
    roots = durable(ranked(nodes.select(F.col("_tree").alias("_of"), "_node"), ["_of"], "_pos"), "roots")
    one = roots.select(F.lit("").alias("_tree"), "_pos", "_node", F.lit(0).alias("_level"), "_of").withColumn("_block", F.floor(F.col("_pos") / arity**height).cast("long"))
    above = _ways(durable(_upper(one, 0, arity), "nodes"), height, arity, height, top)
    ways = _walk(one, above, 0, arity, ["_of", "_node"])
    return durable(ways.select(F.col("_of").alias("_tree"), F.lit(0).cast("long").alias("_pos"), F.col("_node").alias("_subroot"), "_root", "_left", "_right"), "ways")


def _walk(nodes: DataFrame, above: dict | DataFrame, base: int, arity: int, keep: list[str]) -> DataFrame:
    """The kept columns of nodes (with _block) and their way to the root, given the ways of the blocks."""
    schema = T.StructType([*nodes.select(*keep).schema.fields, *T.StructType.fromDDL(_WAY).fields])

    def ways(table: pa.Table, subroot: str, root: str, left: list[str], right: list[str]) -> pa.Table:
        table, levels, rise = _block(table, base, arity)
        own = [_way(levels, i, arity) for i in range(len(table))]
        lift = [[""] * n for n in rise]
        sides = [pa.array([[*up, *w[k], *rest] for up, w in zip(lift, own, strict=True)], pa.list_(pa.string())) for k, rest in ((0, left), (1, right))]
        columns = [table[c] for c in keep] + [pa.array([x] * len(table), pa.string()) for x in (subroot, root)] + sides
        return pa.table(columns, names=[*keep, "_subroot", "_root", "_left", "_right"])

    grouped = nodes.select(*dict.fromkeys(["_tree", "_block", "_pos", "_node", "_level", *keep])).groupBy("_tree", "_block")
    if isinstance(above, dict):
        known = nodes.sparkSession.sparkContext.broadcast(above)  # at most `top` nodes
        return grouped.applyInArrow(lambda t: ways(t, *known.value[t["_tree"][0].as_py(), t["_block"][0].as_py()]), schema)
    named = above.withColumnRenamed("_pos", "_block").groupBy("_tree", "_block")
    return grouped.cogroup(named).applyInArrow(lambda t, a: ways(t, *[a[c][0].as_py() for c in ("_subroot", "_root", "_left", "_right")]), schema)


def proofs(rows: DataFrame, source: str = "source", leaf: str = "leaf", order: tuple[str, ...] = ("doc_id",), arity: int = ARITY, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """rows with subroot, root, left and right: the root of its source's tree, that of all sources, and its proof.

    Per source, leaves ascend by ``order``, then by the leaf itself; equal leaves stand in an arbitrary order.  While more
    than one node remains, every ``arity`` consecutive ones become their digest; a lone leaf is its subroot.  Subroots,
    ordered by source (null first, then UTF-8 bytes), make root in the same way.  left and right hold, level by level, the
    siblings before and after the node on the way, as one text each.  Rows may have any columns, in nested ones as well;
    columns of the new names are replaced.  Leaves must not be null.  An empty table has no root and no rows.
    """
    rows = rows.drop("subroot", "root", "left", "right")
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))
    named = durable(rows.select(tree.alias("_tree"), *[F.col(c).alias(f"_key{k}") for k, c in enumerate(order)], F.col(leaf).alias("_node"), F.struct("*").alias("_row"), F.lit(1).alias("_one")), "leaves")
    keys = [f"_key{k}" for k in range(len(order))]
    placed = prefix_sums(named, ["_tree", *keys, "_node"], "_one", within=["_tree"])
    leaves = placed.select("_tree", F.col("rank").alias("_pos"), "_node", F.lit(0).alias("_level"), "_row")
    leaves = durable(leaves.withColumn("_block", F.floor(F.col("_pos") / arity**height).cast("long")), "placed")
    above = _ways(durable(_upper(leaves, 0, arity), "nodes"), height, arity, height, top)
    found = _walk(leaves, above, 0, arity, ["_row"])
    return found.select("_row.*", F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_left").alias("left"), F.col("_right").alias("right"))


def plain_root(leaves: dict[str | None, list[str]], arity: int = ARITY) -> Iterator[str]:
    """The subroots and then the root of a few leaves, on the driver: what auditors without a cluster recompute."""
    subroots = [_levels(own, arity)[-1][0] for _, own in sorted(leaves.items(), key=lambda x: (x[0] is not None, (x[0] or "").encode()))]
    yield from subroots
    yield from _levels(subroots, arity)[-1]
