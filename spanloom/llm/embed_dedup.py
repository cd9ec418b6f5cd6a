"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), nearest first.  Inverted lists hold, for each label
and pivot, the vectors that name the pivot; two vectors are candidates if they share enough pivots, and candidates are
verified by their cosine in double precision.

Each label has its own pivots, drawn from its vectors by a hash; their number grows with the square root of the label's
vectors.  Nearness to a pivot is measured after the label's mean is taken off, because real embeddings have a common
direction that would make every vector name the same pivots.  How many nearest pivots describe a vector is found on
the sample: as few as suffice for pairs made to lie exactly at the bound.  A list that is too long is split by the next
pivot of its members' permutations, so that the work stays near linear in the rows; lists that are still long hold
dense groups, and are cut into chunks that meet in tiles of bounded size.  Pairs exist only inside a tile, as entries
of a numpy matrix, and leave it as counts of links and as a spanning forest.  Equal vectors of one label are one entry
with a multiplicity.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.batches import small_batches
from spanloom.functions.durable import durable
from spanloom.llm.components import components
from spanloom.llm.tiles import groups

#: Rows of one side of a tile.
TILE = 512


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Double-precision unit vectors; None for null, empty or zero vectors and for null or non-finite components."""
    out: list[np.ndarray | None] = []
    for item in column:
        values = item.values if item.is_valid else None
        if values is None or len(values) == 0 or values.null_count:
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        norm = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
        if not 0 < norm < math.inf:  # subnormal or huge components: scale first
            top = float(np.abs(v).max()) if np.isfinite(v).all() else 0.0
            v = v / top if top else v
            norm = math.sqrt(float(v @ v)) if top else 0.0
        out.append(v / norm if norm > 0 else None)
    return out


#: Numbers of nearest pivots that may describe a vector; the first that finds enough of the pairs at the bound is taken.
NEAREST = (6, 8, 10, 12, 16, 24, 32, 48)

#: With so few pivots every vector names WIDE of them: two such choices always share two, so no link can be missed.
FEW, WIDE = 30, 16

#: Pairs at the bound, made from the sample, on which the number of nearest pivots is measured; and the share to find.
PROBES, FOUND = 256, 0.97

#: Added to the numbers of pivots with long lists, so that they come after all others.
LONG = 1 << 30


def pivot_count(rows: int) -> int:
    """Reference points for so many vectors: twice the square root."""
    return max(FEW, 2 * math.isqrt(max(rows, 1)))


def thinned(points: np.ndarray, most: float) -> np.ndarray:
    """The points, in order, without those whose cosine to an earlier one kept is over ``most``.

    Many pivots inside one dense group would be told apart by noise only, and its members would not agree on them.
    """
    kept = points[:0]
    for at in range(0, len(points), 512):
        block = points[at : at + 512]
        if len(kept):
            block = block[(block @ kept.T).max(axis=1) <= most]
        near, own = block @ block.T > most, np.ones(len(block), dtype=bool)
        for i in range(len(block)):
            if own[i]:
                own[i + 1 :] &= ~near[i, i + 1 :]
        kept = np.concatenate([kept, block[own]])
    return kept


def permutations(units: np.ndarray, pivots: np.ndarray, centre: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the ``nearest`` pivots of each vector (all, if there are fewer), nearest first."""
    nearest = min(nearest, len(pivots))
    points = _lengthened(pivots - centre)
    out = []
    for at in range(0, len(units), 2048):
        close = _lengthened(units[at : at + 2048] - centre) @ points.T
        top = np.argpartition(-close, nearest - 1, axis=1)[:, :nearest] if nearest < len(pivots) else np.tile(np.arange(len(pivots)), (len(close), 1))
        own = np.take_along_axis(close, top, axis=1)
        out.append(np.take_along_axis(top, np.lexsort((top, -own), axis=1), axis=1))
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, nearest), np.int32)


def _lengthened(points: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    norm = np.sqrt(np.einsum("ij,ij->i", points, points))
    return points / np.where(norm > 0, norm, 1)[:, None]


def describe_sample(sample: np.ndarray, count: int, cosine: float, shared: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(pivots, centre, nearest) from a sample of unit vectors, of which the first ``count`` may be pivots.

    If no number of nearest pivots finds enough pairs, the largest is taken.
    """
    centre, pivots = sample.mean(axis=0), thinned(sample[:count], cosine)
    if len(pivots) <= max(FEW, 2 * WIDE - shared):
        return pivots, centre, min(len(pivots), max(WIDE, (len(pivots) + shared + 1) // 2))
    probes = sample[-PROBES:]
    other = np.roll(sample, 1, axis=0)[-PROBES:] - centre  # pairs at the bound, in the directions that vectors differ in
    other = _lengthened(other - np.einsum("ij,ij->i", other, probes)[:, None] * probes)
    partners = cosine * probes + math.sqrt(1 - cosine * cosine) * other
    ends = [permutations(x, pivots, centre, NEAREST[-1]) for x in (probes, partners)]
    for nearest in NEAREST:
        a, b = (e[:, :nearest] for e in ends)
        common = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
        if (common >= min(shared, a.shape[1])).mean() >= FOUND:
            break
    return pivots, centre, min(nearest, len(pivots))


def _rows_of(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A binary column of equal vectors as a matrix of doubles."""
    return np.frombuffer(b"".join(x.as_buffer() for chunk in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) for x in chunk)).reshape(-1, width)


def choose_pivots(entries: DataFrame, sizes: DataFrame, cosine: float, shared: int) -> DataFrame:
    """(label, dim, pivot, vec, nearest): pivots of every label with more than one entry; pivot -1 is the centre.

    They are drawn from about ``pivot_count`` entries of the label and PROBES more, by a hash of their values.
    """
    rows = sizes.where("n > 1")
    wanted = F.floor(F.sqrt(F.col("n").cast("double"))) * 2 + PROBES
    draw = F.pmod(F.xxhash64("unit", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = entries.join(rows, ["label", "dim"]).where(draw < wanted * 1.05 / F.col("n")).select("label", "dim", "n", "unit")

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        label, dim = key[0].as_py(), key[1].as_py()
        sample = _rows_of(table["unit"], dim)
        sample = sample[np.argsort([hash_bytes(row.tobytes()) for row in sample], kind="stable")]
        pivots, centre, nearest = describe_sample(sample, max(FEW, len(sample) - PROBES), cosine, shared)
        vec = [centre.tobytes(), *[p.tobytes() for p in pivots]]
        columns = [[label] * len(vec), [dim] * len(vec), list(range(-1, len(vec) - 1)), vec, [nearest] * len(vec)]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["label", "dim", "pivot", "vec", "nearest"])

    return drawn.groupBy("label", "dim").applyInArrow(choose, "label string, dim int, pivot int, vec binary, nearest int")


def hash_bytes(data: bytes) -> int:
    """A number that orders vectors in a way that has nothing to do with their values."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def described(entries: DataFrame, sizes: DataFrame, pivots: DataFrame) -> DataFrame:
    """entries (label, dim, entry, copies, unit) with ``near``, the pivots of each; a lone entry, whose label has none, names 0.

    The entries of a label are dealt into chunks no smaller than the number of its pivots, and each chunk meets these.
    """
    chunks = sizes.withColumn("chunks", F.ceil(F.col("n") / F.greatest(F.lit(4096), F.floor(F.sqrt(F.col("n").cast("double"))) * 2)).cast("int")).drop("n")
    dealt = entries.join(chunks, ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("entry"), F.col("chunks")).cast("int")).drop("chunks")
    met = pivots.join(chunks, ["label", "dim"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def near(key: tuple, rows: pa.Table, points: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        if points.num_rows:
            points = points.sort_by("pivot")
            vec = _rows_of(points["vec"], dim)
            found = permutations(_rows_of(rows["unit"], dim), vec[1:], vec[0], points["nearest"][0].as_py())
        else:
            found = np.zeros((rows.num_rows, 1), np.int32)
        ends = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * found.shape[1])
        lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
        return rows.select(["label", "dim", "entry", "copies", "unit"]).append_column("near", lists)

    key = ["label", "dim", "chunk"]
    return dealt.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(near, "label string, dim int, entry long, copies long, unit binary, near array<int>")


def placed_keys(rows: DataFrame, shared: int) -> DataFrame:
    """(label, dim, entry, p, q, near) for described rows: the lists in which each entry stands.

    A list of at most TILE entries is kept by its pivot q (p is -1).  Longer ones are split: two entries that share
    two long lists meet in the list of both pivots, p < q.  With ``shared`` of 1 nothing is split.  Two entries meet in several lists, and the
    tile of the first of these in the order of (p, q) counts them.
    """
    named = rows.select("label", "dim", F.explode("near").alias("pivot"))
    sizes = named.groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).where(F.col("n") > (TILE if shared > 1 else 1 << 62))
    longs = sizes.groupBy("label", "dim").agg(F.collect_list("pivot").alias("longs"))
    marked = rows.select("label", "dim", "entry", "near").join(longs, ["label", "dim"], "left")
    split = (F.size("near") > 1) & F.col("longs").isNotNull()
    near = F.when(split, F.sort_array(F.transform("near", lambda x: F.when(F.array_contains("longs", x), x + LONG).otherwise(x)))).otherwise(F.sort_array("near"))
    pair = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    short = F.transform(F.filter("near", lambda x: x < LONG), lambda x: pair(F.lit(-1), x))
    both = F.flatten(F.transform(F.filter("near", lambda x: x >= LONG), lambda x: F.transform(F.filter("near", lambda y: y > x), lambda y: pair(x, y))))
    keys = marked.withColumn("near", near).select("label", "dim", "entry", "near", F.explode(F.concat(short, both)).alias("at"))
    return keys.select("label", "dim", "entry", "near", "at.p", "at.q")


def link_vectors(
    vectors: DataFrame, cosine: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    shared: int = 2, exact: bool = False,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors.

    Rows are compared only where labels are equal and not null.  A link is a cosine of at least ``cosine`` between two
    rows that share at least ``shared`` of their nearest pivots (all, if there are fewer pivots).  n_links counts the
    other rows linked directly, component_id is the smallest vec_id that links reach, kept tells vec_id = component_id.
    None below the bound is made.  Every label goes through its pivots, whatever its size.  Links that the index doesn't
    find are missed: fewer than 1 - FOUND of those exactly at the bound, by the measure on the sample, less of closer
    ones, and none in labels of at most FEW pivots (some 225 vectors); where NEAREST[-1] pivots find fewer than FOUND on
    the sample, more.  With ``exact`` every label is compared in full, without loss and at quadratic cost.

    Null or empty vectors, zero vectors, and null or non-finite components link with nothing, nor do vectors of
    different lengths.  Rows with a null vec_id link with nothing and have a null component (kept is then null).
    Repeated rows are rows like any other: they link with each other.  Other columns are ignored.  An empty table gives
    an empty result.
    """
    small_batches(vectors.sparkSession)

    def normal(batches):
        for batch in batches:
            unit = [None if v is None else v.tobytes() for v in _vectors(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, type=pa.binary())], ["vec_id", "label", "unit"])

    rows = vectors.selectExpr(
        f"cast(`{id_column}` as long) vec_id", f"cast(`{label_column}` as string) label", f"cast(`{vector_column}` as array<double>) v"
    ).mapInArrow(normal, "vec_id long, label string, unit binary")
    rows = durable(rows.withColumn("unit", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("unit"))), "vectors")
    usable = rows.where("unit is not null")
    entries = durable(
        usable.groupBy("label", "unit").agg(F.min("vec_id").alias("entry"), F.count("*").alias("copies"))
        .withColumn("dim", (F.octet_length("unit") / 8).cast("int")), "entries",
    )
    if exact:
        near = entries.withColumn("near", F.array(F.lit(0)))
    else:
        sizes = durable(entries.groupBy("label", "dim").agg(F.count("*").alias("n")), "sizes")
        pivots = durable(choose_pivots(entries, sizes, cosine, shared), "pivots")
        near = durable(described(entries, sizes, pivots), "described")
    keys = durable(placed_keys(near, shared), "keys")
    key = ["label", "dim", "p", "q"]
    size = keys.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int")).drop("n")
    placed = (
        keys.join(size, key)
        .withColumn("chunk", F.pmod(F.xxhash64("entry", "p", "q"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*key, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "entry", "near")
        .join(entries.select("entry", "label", "dim", "copies", "unit"), ["entry", "label", "dim"])
    )
    key = [*key, "i", "j"]
    found = placed.select(*key, "chunk", "entry", "near", "copies", "unit").repartition(*key).sortWithinPartitions(*key)
    links = durable(found.mapInArrow(lambda b: _links(b, key, cosine, shared), "entry long, n long, a long, b long"), "links")
    root = components(links.where("a is not null").select("a", "b"))
    found = links.where("n is not null").groupBy("entry").agg(F.sum("n").alias("n"))
    named = entries.join(found, "entry", "left").join(root.withColumnRenamed("node", "entry"), "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    least = named.groupBy("root").agg(F.min("entry").alias("component_id"))
    named = durable(
        named.join(least, "root").select("label", "unit", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named"
    )
    out = rows.join(named, ["label", "unit"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _tile(rows: pa.Table, cosine: float, shared: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(entries, their linked rows, a spanning forest of the links) of one tile."""
    p, q, dim, lone = (rows[c][0].as_py() for c in ("p", "q", "dim", "i"))
    lone = lone == rows["j"][0].as_py()
    entry, copies, chunk = (rows[c].to_numpy() for c in ("entry", "copies", "chunk"))
    unit = _rows_of(rows["unit"], dim)
    near = rows["near"].combine_chunks()
    flat, width = near.flatten().to_numpy(), len(near[0])
    names, place = np.unique(flat, return_inverse=True)
    hot = np.zeros((len(entry), len(names)), dtype=np.float32)
    np.put_along_axis(hot, place.reshape(len(entry), width), 1, axis=1)
    earlier = hot[:, names < q]
    able = (hot @ hot.T >= min(shared, width)) & (earlier @ earlier.T == (0 if p < 0 else 1))
    able &= np.triu(np.ones_like(able), 1) if lone else chunk[:, None] < chunk[None, :]
    x, y = np.nonzero(able & (unit @ unit.T >= cosine - 1e-9))
    ok = np.concatenate([np.einsum("ij,ij->i", unit[x[s : s + 65536]], unit[y[s : s + 65536]]) for s in range(0, len(x), 65536)] or [np.zeros(0)]) >= cosine
    x, y = x[ok], y[ok]
    linked = np.bincount(x, copies[y], len(entry)) + np.bincount(y, copies[x], len(entry))
    up = list(range(len(entry)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    forest = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        if (a := top(a)) != (b := top(b)):
            up[max(a, b)] = min(a, b)
            forest.append((int(entry[a]), int(entry[b])))
    some = np.flatnonzero(linked)
    return entry[some], linked[some].astype(np.int64), forest


def _links(batches, key: list[str], cosine: float, shared: int):
    """Rows (entry, n, null, null) and (null, null, a, b) of all tiles of a partition sorted by key."""
    for table in groups(batches, key):
        entry, n, forest = _tile(table, cosine, shared)
        gap, none = pa.nulls(len(entry), pa.int64()), pa.nulls(len(forest), pa.int64())
        a, b = (pa.array([f[k] for f in forest], pa.int64()) for k in (0, 1))
        columns = [(pa.array(entry, pa.int64()), none), (pa.array(n, pa.int64()), none), (gap, a), (gap, b)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["entry", "n", "a", "b"])
