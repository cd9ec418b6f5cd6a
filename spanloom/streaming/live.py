"""Open calls, shown while they go on: what was shown is retracted and replaced when a later turn changes it.

A state for each call keeps its turns as they were last heard and counts its revisions; a turn that is heard again (a
sentence that grows) replaces its earlier form, and one that arrives late takes its place.  Each changed call is detected
and rendered as a whole, and the difference to what was shown is appended to a log of ``show`` and ``retract`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spanloom.functions.durable import durable, path_exists
from spanloom.operators import detect, policy, render

REVISION = "call_id string, seq long, turn int, text string"
LOG = "call_id string, tier string, turn int, text string, seq long, op string, batch long"
#: The state store that the processor needs (a session setting).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenCall(StatefulProcessor):
    """One call's turns: rows (call_id, turn, rev, text) in, all turns of the call out whenever one of them changes."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Open the states: turns by number, the revision, and whether the call is over."""
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn int", "rev long, text string")
        self.seq = handle.getValueState("seq", "seq long")
        self.over = handle.getValueState("over", "over boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Take newer forms of turns; older ones, and turns of a call that is over, are stale and change nothing."""
        changed = False
        for frame in rows:
            for turn, rev, text in zip(frame["turn"], frame["rev"], frame["text"], strict=True):
                if self.over.exists() or pd.isna(turn):
                    continue
                at, rev, text = (int(turn),), 0 if pd.isna(rev) else int(rev), "" if text is None else str(text)
                known = self.turns.getValue(at) if self.turns.containsKey(at) else None
                # of equal revisions the larger text stays, so that no order of arrival matters
                if known is None or (rev, text) > (known[0], known[1]):
                    self.turns.updateValue(at, (rev, text))
                    changed = True
        if not changed:
            return
        seq = (self.seq.get()[0] if self.seq.exists() else 0) + 1
        self.seq.update((seq,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        every = sorted((k[0], v[1]) for k, v in self.turns.iterator())
        yield pd.DataFrame({"call_id": [key[0]] * len(every), "seq": [seq] * len(every), "turn": [t for t, _ in every], "text": [x for _, x in every]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The call is over: its turns are let go, and later ones are stale."""
        self.turns.clear()
        self.over.update((True,))
        yield from ()

    def close(self) -> None:
        """Nothing is held outside the states."""


def revisions(turns: DataFrame, idle_minutes: float | None = 60) -> DataFrame:
    """(call_id, seq, turn, text) of a stream of turns (call_id, turn, rev, text): a changed call's turns, all of them.

    rev orders the forms of one turn (null: 0).  A call that nobody has changed for ``idle_minutes`` is over; with None,
    calls stay open, and the query can end when all that is available has been read.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    named = turns.select(F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("int").alias("turn"), F.col("rev").cast("long").alias("rev"), "text").where("call_id is not null")
    return named.groupBy("call_id").transformWithStateInPandas(
        OpenCall(None if idle_minutes is None else round(idle_minutes * 60_000)), REVISION, "Update", "None" if idle_minutes is None else "ProcessingTime"
    )


def rendered_calls(turns: DataFrame, secret: bytes) -> DataFrame:
    """(call_id, tier, turn, text): whole calls as every tier sees them, turn by turn.  turns: (call_id, turn, text)."""
    texts = detect.call_texts(turns)
    shown = render.render(texts, render.replacements(detect.detect(turns), texts, policy.actions(turns.sparkSession), secret))
    place = turns.select(F.col("call_id").alias("id"), F.col("turn").alias("_turn"), (F.row_number().over(Window.partitionBy("call_id").orderBy("turn")) - 1).alias("turn"))
    return render.rendered_turns(shown).join(place, ["id", "turn"]).select(F.col("id").alias("call_id"), "tier", F.col("_turn").alias("turn"), "text")


def _log(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The rows of the log that batches before this one wrote."""
    rows = spark.read.schema(LOG).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], LOG)
    return rows.where(F.col("batch") < before)


def shown(log: DataFrame) -> DataFrame:
    """(call_id, tier, turn, text, seq): what is shown now by a log of (call_id, tier, turn, text, seq, op)."""
    last = log.groupBy("call_id", "tier", "turn").agg(F.max(F.struct("seq", (F.col("op") == "show").alias("up"), "text")).alias("x"))
    return last.where("x.up").select("call_id", "tier", "turn", "x.text", "x.seq")


def revise(changed: DataFrame, log: DataFrame, secret: bytes) -> DataFrame:
    """Rows (call_id, tier, turn, text, seq, op) that bring what the log shows to what the changed calls say.

    changed: (call_id, seq, turn, text).  A call whose revision the log has already, or a later one, is stale.
    """
    ids = changed.groupBy("call_id").agg(F.max("seq").alias("seq"))
    known = shown(log.join(F.broadcast(ids.select("call_id")), "call_id", "left_semi"))  # the calls of one micro-batch
    newest = known.groupBy("call_id").agg(F.max("seq").alias("known"))
    fresh = ids.join(newest, "call_id", "left").where("known is null or seq > known").select("call_id", "seq")
    turns = durable(changed.join(fresh, ["call_id", "seq"]).select("call_id", "turn", "text"), "changed")
    now = rendered_calls(turns, secret).join(fresh, "call_id")
    both = now.alias("a").join(known.alias("b"), ["call_id", "tier", "turn"], "left").where("b.text is null or a.text <> b.text")
    rows = F.array(F.struct(F.col("b.text").alias("text"), F.lit("retract").alias("op")), F.struct(F.col("a.text").alias("text"), F.lit("show").alias("op")))
    return both.select("call_id", "tier", "turn", F.col("a.seq").alias("seq"), F.explode(rows).alias("x")).where("x.text is not null").select("call_id", "tier", "turn", "x.text", "seq", "x.op")


def show_open_calls(turns: DataFrame, path: str, checkpoint: str, secret: bytes, idle_minutes: float | None = 60, **trigger) -> StreamingQuery:
    """Start the query that keeps the log at ``path`` up to a stream of turns (call_id, turn, rev, text).

    A micro-batch that is run again writes its part of the log again, never twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = durable(batch, "revisions")
        if changed.isEmpty():  # a batch that only looks for timers
            return
        rows = revise(changed, _log(spark, path, number), secret).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = revisions(turns, idle_minutes).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
