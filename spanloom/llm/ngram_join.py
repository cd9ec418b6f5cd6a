"""Documents whose word n-gram sets overlap: a blocked sparse product of the document by n-gram incidence matrix.

The product of the incidence matrix with its transpose holds the overlap count of every two documents.  Only entries
of at least the Jaccard bound are wanted, and the bound follows from the two row sizes, so most of the product is never
formed:

* Rows are put in size bands so narrow that linked rows lie in the same or in neighbouring bands.
* The columns (n-gram hashes) are cut into blocks.  Two rows of a band that may be linked differ in at most ``d``
  columns; with more than ``d`` blocks, at least one block of theirs is equal in full.  A digest of each block of a row
  therefore tells which blocks of rows must be multiplied at all: those that share a digest.  No linked pair is lost.
* These blocks of rows are multiplied in tiles of bounded size.  A tile takes its columns rarest first, block by block,
  and accumulates the overlap counts of all its pairs as a product of matrices.  A pair is dropped as soon as its count, with
  all that the smaller rest of the two rows could still add, stays below the least overlap that their sizes allow;
  rows without a pair leave the tile.
* Before whole rows are moved to a tile, sketches of them are: how many columns fall into each of some buckets.  Two rows
  differ in at least as many columns as their sketches do, so a row that no other can reach is left out; no linked pair is.
* The rows of a digest are multiplied with one leader row first (a tile of one row, linear in the group).  What remains
  are rows of one leader in different components than it; only these are multiplied with the leader's other rows as well.

Equal sets share one row, so copies cost nothing beyond their own membership.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.batches import BATCH_BYTES, small_batches
from spanloom.functions.durable import durable
from spanloom.llm import textkernel as tk
from spanloom.llm.components import components
from spanloom.llm.tiles import groups

#: How many partitions of the columns are tried when a row leaves too many blocks of a partition empty.
SEEDS = 6


class Bands:
    """Row size bands and the number of column blocks of each, for the bound ``num / den``."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the Jaccard bound must lie in (0, 1]")
        self.num, self.den = num, den
        self.edges = [1]
        self.blocks: list[tuple[int, int]] = []

    def _grow(self) -> None:
        low = self.edges[-1]
        high = max(low + 1, -(-low * self.den // self.num))
        self.edges.append(high)
        small, large = high - 1, (high - 1) * self.den // self.num
        differ = (small + large) * (self.den - self.num) // (self.den + self.num)
        count = differ + 1
        if differ:
            filled = lambda m: m - m * math.exp(-low / m) - 3 * math.sqrt(m * math.exp(-low / m))
            while filled(count) < differ + 1 and count < 2 * differ + 8:
                count += 1
        self.blocks.append((differ, count))

    def band(self, size: int) -> int:
        """The band of a row with ``size`` columns."""
        while self.edges[-1] <= size:
            self._grow()
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def roles(self, size: int) -> list[tuple[int, int, int]]:
        """(band, most columns in which linked rows differ, blocks) as the smaller and as the larger row of a pair."""
        i = self.band(size)
        out = [(i, *self.blocks[i])]
        if i and size <= (self.edges[i] - 1) * self.den // self.num:
            out.append((i - 1, *self.blocks[i - 1]))
        return [x for x in out if x[1]]  # rows that may not differ at all are one row already


@lru_cache(maxsize=8)
def _bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def set_digest(columns: np.ndarray) -> int:
    """One 64-bit number for a whole set."""
    return int((tk.mix(columns ^ tk.U64(0x5851F42D4C957F2D)).sum() + tk.U64(len(columns))).astype(np.int64))


def block_digests(columns: np.ndarray, bands: Bands) -> np.ndarray:
    """The digests under which a row (sorted, distinct column hashes) meets every row that it may be linked with."""
    out = []
    for band, differ, count in bands.roles(len(columns)):
        for seed in range(SEEDS):
            own = columns if seed == 0 else np.sort(tk.mix(columns + tk.U64(seed)))
            block = ((own >> tk.U64(32)) * tk.U64(count)) >> tk.U64(32)
            heads = np.flatnonzero(np.diff(block, prepend=block[0] + tk.U64(1)))
            tag = tk.mix(tk.U64((band << 3 | seed) + 1) + (block[heads] << tk.U64(24)))
            out.append(tk.mix(np.add.reduceat(tk.mix(own ^ tk.U64(0xA24BAED4963EE407)), heads) ^ tag))
            if len(heads) > differ:
                break  # fewer blocks are empty than must be equal: one that is equal has columns
        else:
            empty = np.setdiff1d(np.arange(count, dtype=tk.U64), block[heads])
            out.append(tk.mix(tk.mix(tk.U64((band << 3 | 7) + 1) + (empty << tk.U64(24)))))
    return np.concatenate(out) if out else columns[:0]


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row in the batch, its set of shingles) over the whole texts of the batch's column ``text``."""
    data, offsets, _ = tk.text_buffers(batch.column("text"))
    for i, j in tk.slices(offsets):
        own = offsets[i : j + 1]
        hashed, _, first, _ = tk.word_hashes(data[own[0] : own[-1]], own - own[0], ~tk.SPACE)
        yield from enumerate(tk.shingles(hashed, first, words), i)


def shingle_rows(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, node): the size and digest of each document's set (null if empty or without doc_id)."""

    def rows(batches):
        for batch in batches:
            size, node = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for i, columns in _sets(batch, words):
                size[i] = len(columns)
                if len(columns):
                    node[i] = set_digest(columns)
            doc = batch.column("doc_id").cast(pa.int64())
            none = (size == 0) | np.asarray(doc.is_null())
            yield pa.RecordBatch.from_arrays([doc, pa.array(size), pa.array(node, mask=none)], ["doc_id", "n_shingles", "node"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, node long")


def block_rows(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(digest, node, others): a row's block digests; rows of one Arrow batch with an equal digest come as one row.

    A digest that very many rows have thus reaches the shuffle once per batch, with the other members in a list.
    """

    def rows(batches):
        bands = _bands(num, den)
        for batch in batches:
            nodes, keys, seen = [], [], set()
            for _, columns in _sets(batch, words):
                if len(columns) and (node := set_digest(columns)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    keys.append(block_digests(columns, bands))
            if not nodes:
                continue
            count = np.array([len(k) for k in keys])
            key, node = np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, dtype=np.int64), count)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            heads = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
            length = np.diff(np.append(heads, len(key)))
            rest = np.ones(len(key), dtype=bool)
            rest[heads] = False
            ends = np.concatenate([[0], np.cumsum(length - 1)]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(ends), pa.array(node[rest]), mask=pa.array(length == 1))
            for s in range(0, len(heads), 200_000):  # the JVM copies a batch as a whole
                part = slice(s, s + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[heads[part]]), pa.array(node[heads[part]]), others[part]],
                    ["digest", "node", "others"],
                )

    return docs.where("doc_id is not null").select("text").mapInArrow(rows, "digest long, node long, others array<long>")


def shared_digests(blocks: DataFrame) -> DataFrame:
    """(digest, node): the members of every digest that at least two different rows have."""
    own = Window.partitionBy("digest")
    return (
        blocks.withColumns({"low": F.min("node").over(own), "high": F.max("node").over(own)})
        .where((F.col("low") != F.col("high")) | F.col("others").isNotNull())
        .select("digest", F.explode(F.concat(F.array("node"), F.coalesce("others", F.array().cast("array<long>")))).alias("node"))
        .distinct()
    )


def stars(members: DataFrame) -> DataFrame:
    """(leader, node): each digest's members with the one of them that meets most others over all digests."""
    count = members.groupBy("digest").agg(F.count("*").alias("n"))
    weight = members.join(count, "digest").groupBy("node").agg(F.sum(F.col("n") - 1).alias("weight"))
    best = (
        members.join(weight, "node")
        .groupBy("digest")
        .agg(F.max(F.struct("weight", "node"))["node"].alias("leader"))
    )
    return members.join(best, "digest").where("leader <> node").select("leader", "node").distinct()


#: Rows of one side of a tile, entries of the incidence matrix in one side, and columns of one block of its product.
TILE, ENTRIES, BLOCK = 512, 1 << 17, 2048

#: Document ids that may be broadcast to pick texts: 8 bytes each.  More are joined through a shuffle.
BROADCAST_IDS = 2_000_000


def multiply(a: list[np.ndarray], b: list[np.ndarray], able: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs that ``able`` allows whose rows a[i] and b[j] reach the bound: a tile of the sparse product.

    Rows are sets of column hashes.  Columns that only one row of the tile has can't be shared; the others are taken rarest first.
    """
    na, nb = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    need = -(-num * (na[:, None] + nb[None, :]) // (den + num))
    live = able & (np.minimum(na[:, None], nb[None, :]) >= need)
    if not live.any():
        return np.nonzero(live)
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(times, kind="stable")
    order = order[times[order] > 1]
    place = np.full(len(times), -1)
    place[order] = np.arange(len(order))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    rest = np.bincount(row, minlength=len(a) + len(b))
    count = np.zeros(live.shape, dtype=np.float32)
    for start in range(0, len(order), BLOCK):
        live &= count + np.minimum(rest[: len(a), None], rest[None, len(a) :]) >= need
        if not live.any():
            return np.nonzero(live)
        own = slice(*np.searchsorted(column, [start, start + BLOCK]))
        one = np.zeros((len(a) + len(b), min(BLOCK, len(order) - start)), dtype=np.float32)
        one[row[own], column[own] - start] = 1
        x, y = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
        count[np.ix_(x, y)] += one[x] @ one[len(a) + y].T
        rest -= one.sum(axis=1).astype(np.int64)
    return np.nonzero(live & (count >= need))


def sketch(columns: np.ndarray) -> bytes:
    """How many columns of a row fall into each of some buckets (a power of two, about one for three columns), at most 255."""
    bits = max(4, (len(columns) // 3).bit_length())
    counts = np.bincount((tk.mix(columns ^ tk.U64(0x9FB21C651E98DF25)) >> tk.U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def within_reach(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, able: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows a and of the rows b (sketches, and their sizes) may reach the bound with some row that ``able`` allows.

    Finer sketches are folded to the coarsest: sums of neighbouring buckets differ by no more than the buckets do.
    """
    small = np.minimum(na[:, None], nb[None, :])
    differ = na[:, None] + nb[None, :] - 2 * -(-num * (na[:, None] + nb[None, :]) // (den + num))
    live = able & (na[:, None] + nb[None, :] - 2 * small <= differ)
    size = min(map(len, [*a, *b]), default=0)
    x, y = (np.array([np.frombuffer(s, dtype=np.uint8).reshape(size, -1).sum(axis=1, dtype=np.int32) for s in side], dtype=np.int32) for side in (a, b))
    for i in np.flatnonzero(live.any(axis=1)):
        near = np.flatnonzero(live[i])
        live[i, near] = np.abs(y[near] - x[i]).sum(axis=1) <= differ[i, near]
    return live.any(axis=1), live.any(axis=0)


def full_rows(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, columns, sketch): the whole set of each of nodes (doc_id, node), as bytes; texts are read for these only."""
    wanted = durable(nodes.select("doc_id", "node"), "wanted")
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def full(batches):
        for batch in batches:
            found, size = [], 0
            for _, c in _sets(batch, words):
                if len(c):
                    found.append((set_digest(c), c.tobytes(), sketch(c)))
                    size += c.nbytes
                if size > BATCH_BYTES:
                    yield _named(found)
                    found, size = [], 0
            yield _named(found)

    def _named(found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=t) for k, t in enumerate(kinds)], ["node", "columns", "sketch"])

    read = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(full, "node long, columns binary, sketch binary")
    return durable(read.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "rows")


def _tile_links(placed: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): linked rows of all tiles, from placed (leader, i, j, side, node, root), sides 0 and 1 of tile (leader, i, j).

    Rows of equal roots are not compared; a null root is none.  Sketches go to the tiles first, whole rows only where one of
    the other side may be in reach.
    """

    def reaching(batches):
        for table in groups(batches, ["leader", "i", "j"]):
            side, root, n = (table[c].to_numpy() for c in ("side", "root", "n"))
            sketches = table["sketch"].to_pylist()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            x, y = within_reach([sketches[k] for k in a], [sketches[k] for k in b], n[a], n[b], root[a][:, None] != root[b][None, :], num, den)
            yield from table.select(cells).take(np.sort(np.concatenate([a[x], b[y]]))).combine_chunks().to_batches()

    def linked(batches):
        for table in groups(batches, ["leader", "i", "j"]):
            side, node, root = (table[c].to_numpy() for c in ("side", "node", "root"))
            sets = [np.frombuffer(x.as_buffer(), dtype=tk.U64) for chunk in table["columns"].chunks for x in chunk]
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            x, y = multiply([sets[k] for k in a], [sets[k] for k in b], root[a][:, None] != root[b][None, :], num, den)
            yield pa.RecordBatch.from_arrays([pa.array(node[a[x]]), pa.array(node[b[y]])], ["a", "b"])

    key = ["leader", "i", "j"]
    cells = [*key, "side", "node", "root"]
    sketched = rows.select("node", "sketch", (F.octet_length("columns") / 8).cast("long").alias("n"))
    dealt = placed.join(sketched, "node").select(*cells, "n", "sketch").repartition(*key).sortWithinPartitions(*key)
    near = dealt.mapInArrow(reaching, dealt.select(*cells).schema)
    tiled = near.join(rows.select("node", "columns"), "node").select(*cells, "columns").repartition(*key).sortWithinPartitions(*key)
    return tiled.mapInArrow(linked, "a long, b long")


def _chunks(wanted: Column) -> Column:
    """How many chunks of about TILE rows and ENTRIES entries the wanted rows (with n, their sizes) make."""
    entries = F.ceil(F.sum(F.when(wanted, F.col("n"))) / ENTRIES)
    return F.greatest(F.ceil(F.count_if(wanted) / TILE), F.coalesce(entries, F.lit(0))).cast("int")


def _leader_tiles(star: DataFrame) -> DataFrame:
    """Tiles of each leader, side 0, with its rows (leader, node, n) in chunks, side 1; all roots differ."""
    size = star.groupBy("leader").agg(_chunks(F.lit(True)).alias("chunks"))
    members = star.join(size, "leader").select("leader", F.lit(0).alias("i"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("j"), F.lit(1).alias("side"), "node", F.col("node").alias("root"))
    heads = members.select("leader", "i", "j").distinct().select("leader", "i", "j", F.lit(0).alias("side"), F.col("leader").alias("node"), F.col("leader").alias("root"))
    return heads.unionByName(members)


def _odd_tiles(star: DataFrame, roots: DataFrame) -> DataFrame:
    """Tiles of each leader's rows in other components than its own, side 0, with all its rows, side 1, chunk by chunk."""
    own = star.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = own.join(roots.select(F.col("node").alias("leader"), F.col("root").alias("top")), "leader", "left").withColumn("odd", F.col("root") != F.coalesce("top", "leader"))
    own = durable(own.select("leader", "node", "n", "root", "odd"), "cluster")
    size = own.groupBy("leader").agg(_chunks(F.col("odd")).alias("si"), _chunks(F.lit(True)).alias("sj"), F.count("*").alias("rows"))
    placed = own.join(size.where("si > 0 and rows > 1"), "leader")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where("odd").select("leader", deal("si").alias("i"), every("sj").alias("j"), F.lit(0).alias("side"), "node", "root")
    return left.unionByName(placed.select("leader", every("si").alias("i"), deal("sj").alias("j"), F.lit(1).alias("side"), "node", "root"))


def ngram_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Two documents are linked when ``den * |intersection| >= num * |union|`` holds for their sets of ``words``-word
    shingles (A-Z lower-cased, words are runs of bytes other than space and 9 to 13; a text with fewer words is one
    shingle).  ``component_id`` is the smallest doc_id that links reach.

    Null or empty texts and texts without words have n_shingles 0 and are their own component.  A row with a null doc_id
    is linked with nothing and has a null component.  Repeated rows come back as often as they came; rows that share
    a doc_id but not the text are linked only if their texts are.  Other columns are ignored.  An empty table gives an
    empty result.  Sets are identified by 64-bit digests.
    """
    small_batches(docs.sparkSession)
    base = durable(shingle_rows(docs, words), "shingles")
    nodes = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    members = durable(shared_digests(block_rows(docs, words, num, den)), "members")
    rows = full_rows(docs, nodes.join(members.select("node").distinct(), "node"), words)
    sizes = rows.select("node", (F.octet_length("columns") / 8).cast("long").alias("n"))
    star = durable(stars(members).join(sizes, "node").select("leader", "node", "n"), "stars")
    first = durable(_tile_links(_leader_tiles(star), rows, num, den), "links")
    roots = durable(components(first), "roots")
    second = durable(_tile_links(_odd_tiles(star, roots), rows, num, den).distinct(), "links")
    top = durable(components(first.union(second)), "roots") if not second.isEmpty() else roots
    least = nodes.join(top, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = least.join(smallest, "root").select("node", "component_id")
    return base.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
