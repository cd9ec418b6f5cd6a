"""A Merkle log that grows: a batch hashes its own entries and a frontier of peaks, and reads no older entry.

Stored are, for every STEP-th level, the nodes of whole subtrees, appended batch by batch, and one head for each batch: the
size and the peaks, which are the roots of the whole subtrees that the size is made of.  Peaks and new leaves give the root
and all new stored nodes; proofs read the stored levels and fold at most 2^STEP nodes for each step of the way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.durable import delete_path, durable, path_exists
from spanloom.operators import audit
from spanloom.operators.audit import STEP

Peak = tuple[int, int, str]
NODE, HEAD = "pos long, hash string", "size long, before long, root string, peaks array<struct<level:int,pos:long,hash:string>>"


def _join(left: str, right: str) -> str:
    return hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()


def pushed(peaks: list[Peak], level: int, nodes: list[tuple[int, str]]) -> list[Peak]:
    """Peaks after more whole subtrees (pos, hash) of one level, in order: equal neighbours become one."""
    peaks = list(peaks)
    for pos, node in nodes:
        own = (level, pos, node)
        while peaks and peaks[-1][0] == own[0]:
            own = (own[0] + 1, own[1] // 2, _join(peaks.pop()[2], own[2]))
        peaks.append(own)
    return peaks


def root_of(peaks: list[Peak]) -> str | None:
    """The root over all peaks: the tree splits at the largest power of two, so they are joined from the right."""
    out = None
    for *_, node in reversed(peaks):
        out = node if out is None else _join(node, out)
    return out


class GrowingLog:
    """The log at ``path``, in a store that all executors share.  One writer at a time.

    A batch is valid once its head is written, last; a batch that failed half-way is written again in its place.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def heads(self) -> DataFrame:
        """(size, before, root, peaks): a row for each batch."""
        known = path_exists(self.spark, f"{self.path}/heads")
        return self.spark.read.schema(HEAD).parquet(f"{self.path}/heads/*") if known else self.spark.createDataFrame([], HEAD)

    def head(self) -> tuple[int, list[Peak]]:
        """The size and the peaks now."""
        last = self.heads().orderBy(F.desc("size")).limit(1).collect()
        return (last[0]["size"], [tuple(p) for p in last[0]["peaks"]]) if last else (0, [])

    def root(self) -> str | None:
        """The root over all entries; None for an empty log."""
        return root_of(self.head()[1])

    def append(self, leaves: DataFrame) -> int:
        """Append leaves (pos from the log's size on without gaps, hash); returns the new size.

        Leaves of another place are an error.  Each task folds at most 2^STEP neighbours.
        """
        size, peaks = self.head()
        fresh = durable(leaves.select(F.col("pos").cast("long").alias("pos"), "hash"), "fresh")
        n, low, high, kinds = fresh.agg(F.count("*"), F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
        if not n:
            return size
        if (low, high, kinds) != (size, size + n - 1, n):
            raise ValueError("leaves must follow the log's last entry without gaps")
        rows, level, frontier = fresh, 0, []
        while True:
            place = f"{self.path}/levels/{level // STEP}/from={size}"
            delete_path(self.spark, place)
            rows.write.parquet(place)
            own = [p for p in peaks if level <= p[0] < level + STEP]
            folded = durable(self._fold(self.spark.read.schema(NODE).parquet(place), level, own), "folded")
            rest = folded.where(F.col("level") < level + STEP).orderBy(F.desc("level")).collect()  # at most STEP peaks
            rows = folded.where(F.col("level") == level + STEP).select("pos", "hash")
            whole = not rows.isEmpty()
            # without a whole group the peaks of higher levels stay; a group that is whole takes this level's peaks into it
            frontier = [(r["level"], r["pos"], r["hash"]) for r in rest] + frontier
            if not whole:
                frontier = [p for p in peaks if p[0] >= level + STEP] + frontier
                break
            level += STEP
        head = [(size + n, size, root_of(frontier), frontier)]
        self.spark.createDataFrame(head, HEAD).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/{size + n}")
        return size + n

    @staticmethod
    def _fold(rows: DataFrame, level: int, peaks: list[Peak]) -> DataFrame:
        """(level, pos, hash): each group of new nodes, with the peaks that begin it, as a whole node or as peaks."""

        def one(key: tuple, table: pa.Table) -> pa.Table:
            group, table = key[0].as_py(), table.sort_by("pos")
            before = [p for p in peaks if p[1] >> (STEP - (p[0] - level)) == group]
            out = pushed(before, level, list(zip(table["pos"].to_pylist(), table["hash"].to_pylist(), strict=True)))
            columns = list(zip(*out, strict=True))
            return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["level", "pos", "hash"])

        group = F.shiftright("pos", STEP).alias("group")
        return rows.select(group, "pos", "hash").groupBy("group").applyInArrow(one, "level int, pos long, hash string")

    def levels(self) -> list[DataFrame]:
        """The stored levels, as the functions of the audit module read them: only batches that have a head."""
        done = sorted(r["before"] for r in self.heads().select("before").collect())  # a row for each batch
        out = []
        while path_exists(self.spark, f"{self.path}/levels/{len(out)}"):
            paths = [p for b in done if path_exists(self.spark, p := f"{self.path}/levels/{len(out)}/from={b}")]
            if not paths:
                break
            out.append(self.spark.read.schema(NODE).parquet(*paths))
        return out

    def inclusion(self, pos: int, size: int | None = None) -> list[str]:
        """The proof that the entry at ``pos`` is in the log of ``size`` entries (now, without it)."""
        return audit.inclusion_proof(self.levels(), pos, size or self.head()[0])

    def consistency(self, old: int, size: int | None = None) -> list[str]:
        """The proof that the log of ``size`` entries begins with the first ``old``."""
        return audit.consistency_proof(self.levels(), old, size or self.head()[0])
