"""Token totals by source, language and tokenizer version, maintained by deltas.

Every batch of changes is turned into signed rows: what a document counted before with -1, what it counts now with +1.
Totals are sums of signed rows, so inserts, deletes and revised counts are all additions, in any order of batches.

A batch is committed under its id: signed rows and their totals are written to the batch's own folders, and an empty
commit table marks them as valid last.  Committing an id again changes nothing, and an attempt that failed half-way is
invisible and is overwritten by the next.  One writer at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.batches import small_batches
from spanloom.functions.durable import delete_path, path_exists

#: The pattern that splits text before merges, as the rank files' own documentation gives it (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SIGNED = "doc_id long, source string, lang string, version string, sign int, tokens long"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


@lru_cache(maxsize=4)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


#: Characters of a piece of a long text that is encoded at once.
PIECE = 1 << 16
#: Where no token goes on by PATTERN: before a blank that stands between a word's end and a letter.
_SEAM = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def pieces(text: str) -> Iterator[str]:
    """A text in pieces whose tokens are together those of the text; a stretch without a seam stays whole."""
    start = 0
    while len(text) - start > PIECE and (seam := _SEAM.search(text, start + PIECE)):
        yield text[start : seam.start()]
        start = seam.start()
    yield text[start:]


def count_tokens(docs: DataFrame, ranks: bytes, column: str = "text") -> DataFrame:
    """docs, its text column replaced by ``tokens``: the tokens of the whole text (null: 0) under a rank file's bytes."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (column, "tokens")]

    def rows(batches):
        encoding = _encoding(ranks)
        for batch in batches:
            count = np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(batch.column(column)):
                if text.is_valid:
                    count[i] = sum(len(encoding.encode_ordinary(piece)) for piece in pieces(text.as_py()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(count)], [*kept, "tokens"])

    schema = docs.select(*kept).schema.add("tokens", "long")
    return docs.select(*kept, column).mapInArrow(rows, schema)


#: Folders by a hash of doc_id in a snapshot: a batch reads those of its own documents only.
BUCKETS = 64


def _folder(name: str) -> str:
    """A name as one folder that no other name has."""
    return "n-" + quote(name, safe="")


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class TokenRollup:
    """A rollup at ``path`` (in a store that all executors share) for one tokenizer: a rank file and its version name.

    After every ``compact_every`` commits of a version the ledger and the totals are written as a snapshot; a commit reads
    the last snapshot, in it only the folders of the documents that it changes, and the batches since.
    """

    def __init__(self, spark: SparkSession, path: str, ranks_file: str, version: str, compact_every: int = 16):
        self.spark, self.path, self.version, self.compact_every = spark, path.rstrip("/"), version, compact_every
        with open(ranks_file, "rb") as f:  # on the driver; its bytes travel with the tasks
            self.ranks = f.read()

    def _at(self, kind: str, version: str, name: str) -> str:
        return f"{self.path}/{kind}/{_folder(version)}/{_folder(name)}"

    def _commits(self) -> dict[str, list[str]]:
        """The ids of each version's committed batches in their order; a row per commit."""
        if not path_exists(self.spark, f"{self.path}/commits"):
            return {}
        done = self.spark.read.schema("id string, version string, seq long").parquet(f"{self.path}/commits/*/*").collect()
        out: dict[str, dict[int, str]] = {}
        for r in done:
            out.setdefault(r["version"], {})[r["seq"]] = r["id"]
        return {v: [ids[k] for k in sorted(ids)] for v, ids in out.items()}

    def _compacted(self, version: str, commits: int) -> int:
        """How many of a version's commits its last complete snapshot holds."""
        k = commits // self.compact_every * self.compact_every
        while k > 0 and not path_exists(self.spark, f"{self._at('snapshot_totals', version, str(k))}/_SUCCESS"):
            k -= self.compact_every
        return max(k, 0)

    def _signed(self) -> DataFrame:
        """(bucket, doc_id, source, lang, version, sign, tokens) of this version: the last snapshot and the batches since."""
        ids = self._commits().get(self.version, [])
        k = self._compacted(self.version, len(ids))
        later = [self._at("signed", self.version, i) for i in ids[k:]]
        rows = self.spark.read.schema(SIGNED).parquet(*later) if later else self.spark.createDataFrame([], SIGNED)
        rows = rows.select(_bucket("doc_id").alias("bucket"), *rows.columns)
        if k:
            rows = rows.unionByName(self.spark.read.schema(f"{SIGNED}, bucket int").parquet(self._at("snapshots", self.version, str(k))))
        return rows

    @staticmethod
    def _net(rows: DataFrame) -> DataFrame:
        net = rows.groupBy("doc_id", "source", "lang", "version", "tokens").agg(F.sum("sign").alias("n"))
        return net.where("n > 0").drop("n")

    def ledger(self) -> DataFrame:
        """(doc_id, source, lang, version, tokens): what every document of this version counts now."""
        return self._net(self._signed())

    def committed(self, batch_id: str) -> bool:
        """Whether this version has the batch."""
        return path_exists(self.spark, f"{self._at('commits', self.version, batch_id)}/_SUCCESS")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply changes (op, doc_id, seq, text, source, lang); False if the batch was committed before.

        op is ``upsert`` (insert, or revise if the document is counted already) or ``delete``.  Of several changes to a
        document the one with the largest seq holds (ties: deletes first, then by text).  Deleting an unknown document
        changes nothing.  Null texts count 0 tokens; null sources and languages are groups of their own; rows with a
        null doc_id or another op are ignored; more columns are too.  Batch ids and versions may be any text.
        """
        if self.committed(batch_id):
            return False
        place = lambda kind: self._at(kind, self.version, batch_id)
        for kind in ("signed", "totals"):
            delete_path(self.spark, place(kind))
        usable = changes.where("doc_id is not null and op in ('upsert', 'delete')").select(
            "op", F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "text", "source", "lang"
        )
        counted = count_tokens(usable.withColumn("text", F.when(F.col("op") == "upsert", F.col("text"))), self.ranks)
        rank = F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), (F.col("op") == "delete").alias("gone"), "tokens", "source", "lang")
        last = counted.groupBy("doc_id").agg(F.max(rank).alias("last")).select("doc_id", "last.*")
        last.select("doc_id", "gone", "source", "lang", "tokens").write.mode("overwrite").parquet(place("changes"))
        last = self.spark.read.schema("doc_id long, gone boolean, source string, lang string, tokens long").parquet(place("changes"))
        version = F.lit(self.version).alias("version")
        own = last.select("doc_id", _bucket("doc_id").alias("bucket"))
        before = self._net(self._signed().join(own, ["bucket", "doc_id"])).select("doc_id", "source", "lang", "version", F.lit(-1).alias("sign"), "tokens")
        now = last.where("not gone").select("doc_id", "source", "lang", version, F.lit(1).alias("sign"), "tokens")
        before.unionByName(now).write.parquet(place("signed"))
        signed = self.spark.read.schema(SIGNED).parquet(place("signed"))
        self._sum(signed.select("source", "lang", "version", F.col("sign").cast("long").alias("n_docs"), (F.col("sign") * F.col("tokens")).alias("n_tokens"))).write.parquet(place("totals"))
        seq = len(self._commits().get(self.version, [])) + 1
        self.spark.createDataFrame([(batch_id, self.version, seq)], "id string, version string, seq long").write.mode("overwrite").parquet(place("commits"))
        delete_path(self.spark, place("changes"))
        if seq % self.compact_every == 0:
            self._compact(seq)
        return True

    def _compact(self, seq: int) -> None:
        """Write the snapshot after the first ``seq`` commits; its totals, written last, make it valid."""
        ledger = self.ledger().select(*[c.split()[0] for c in SIGNED.split(", ") if not c.startswith("sign ")], F.lit(1).alias("sign"))
        place = self._at("snapshots", self.version, str(seq))
        ledger.withColumn("bucket", _bucket("doc_id")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        kept = self.spark.read.schema(f"{SIGNED}, bucket int").parquet(place)
        self._sum(kept.select("source", "lang", "version", F.lit(1).cast("long").alias("n_docs"), F.col("tokens").alias("n_tokens"))).write.mode("overwrite").parquet(self._at("snapshot_totals", self.version, str(seq)))

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all versions; groups without documents are left out."""
        paths = []
        for version, ids in self._commits().items():
            k = self._compacted(version, len(ids))
            paths += ([self._at("snapshot_totals", version, str(k))] if k else []) + [self._at("totals", version, i) for i in ids[k:]]
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return self._sum(rows).where("n_docs <> 0 or n_tokens <> 0")
