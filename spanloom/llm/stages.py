"""The stages of the corpus pipeline.  Each takes (spark, docs, sf_dir); all but the last return documents' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.durable import durable, new_path, path_exists
from spanloom.functions.ranking import prefix_sums
from spanloom.llm import langid, mixing, packing, toxicity
from spanloom.llm.ngram_join import ngram_components

#: A document whose stated language the model contradicts with at least this probability is taken as mislabelled.
MISLABELLED = 0.999


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts, texts without letters, and plainly mislabelled ones."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    wrong = F.col("lang").isNotNull() & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= MISLABELLED)
    return langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & ~wrong).select(*docs.columns)


#: Labels that may be broadcast to the documents: a dozen bytes each.  More are joined through a shuffle.
BROADCAST_LABELS = 2_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """docs (doc_id, text) with a label, without the rows that crc32 keeps for evaluation."""
    marks = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return docs.where(~langid.held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text").join(marks, "doc_id")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the multiple-instance model finds toxic."""
    model = toxicity.fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


#: Ids, with a slot where there is one, that may be broadcast to the documents: at most 24 bytes each.
BROADCAST_IDS = 2_000_000


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents with a 5-word shingle similarity of at least 0.8.

    Where a doc_id is repeated, equal rows (doc_id, text) are one, and different texts are documents of their own: each
    is judged by its own group, of which one row stays (of equal doc_ids, the one whose text has the smaller hash).
    Rows without a doc_id are kept.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _without_duplicates(docs, "doc_id").select(*docs.columns)
    single = known.dropDuplicates(["doc_id", "text"]).withColumns({"_text": F.xxhash64("text"), "_one": F.lit(1)})
    numbered = durable(prefix_sums(single, ["doc_id", "_text"], "_one").withColumnRenamed("rank", "_row"), "numbered")
    kept = _without_duplicates(numbered, "_row").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def _without_duplicates(docs: DataFrame, key: str) -> DataFrame:
    """docs without the near-duplicates of a text with a smaller key."""
    groups = durable(ngram_components(docs.select(F.col(key).alias("doc_id"), "text"), words=5, num=80, den=100), "groups")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(_small(gone), key, "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None, block_bytes: int | None = None) -> DataFrame:
    """Puts all documents in the mixed order: sorted runs of slots, sources interleaved to their target weights.

    weights (source, weight) and block_bytes: see mixing.schedule.
    """
    return _with_slots(docs, weights, block_bytes).repartitionByRange("_slot", "_place").sortWithinPartitions("_slot", "_place").select(*docs.columns)


#: Settings that tell where the slots of some documents under some weights are, by a fingerprint of both.
SLOTS = "spanloom.mixing.slots"


def _fingerprint(df: DataFrame, *columns: Column) -> str:
    """A count and a sum of hashes over all rows, in whatever order they lie."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))).first()
    return f"{n}.{total or 0}"


def _with_slots(docs: DataFrame, weights: DataFrame | None, block_bytes: int | None) -> DataFrame:
    """docs with the ``_slot`` and ``_place`` of their doc_id's first row in the schedule.

    A schedule depends on ids, sources and sizes, weights and block_bytes alone: it is made once for them and found again
    by their fingerprint, so other runs of the session can't be taken for this one.
    """
    spark = docs.sparkSession
    own = _fingerprint(docs, F.col("doc_id"), F.col("source"), F.octet_length("text"))
    given = _fingerprint(weights, F.col("source"), F.col("weight").cast("double")) if weights is not None else "-"
    name = f"{SLOTS}.{own}.{given}.{block_bytes or 0}"
    path = spark.conf.get(name, None)
    if path is None or not path_exists(spark, f"{path}/_SUCCESS"):
        path = new_path(spark, "slots")
        slots = mixing.schedule(docs, weights, block_bytes).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("_at"))
        slots.select(F.col("doc_id").alias("_id"), F.col("_at.slot").alias("_slot"), F.col("_at.place").alias("_place")).write.parquet(path)
        spark.conf.set(name, path)
    slots = spark.read.schema("_id long, _slot long, _place long").parquet(path)
    return docs.join(_small(slots), docs["doc_id"].eqNullSafe(slots["_id"]), "left").drop("_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None, block_bytes: int | None = None) -> DataFrame:
    """Packs all documents, whole, into bins of equal capacity: groups of bins follow the slots of the mixed order.

    The same documents, weights and block_bytes have here the slots that the mixing stage gave them.
    """
    return packing.pack_mixed(_with_slots(docs, weights, block_bytes).withColumnRenamed("_slot", "slot"))
