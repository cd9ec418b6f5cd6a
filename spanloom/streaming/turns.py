"""Turns as a stream: calls close when nobody has spoken for a while, and only then is their text scanned.

A name that is heard late redacts earlier turns as well, so nothing of a call may leave before it is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.detect import format_spans


def closed_calls(turns: DataFrame, gap: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(call_id, opened, closed, text) of a stream of turns (call_id, turn, text, at): one row when a call's session is over.

    A session ends ``gap`` after its last turn; turns that come later than ``late`` behind the newest are dropped, as a
    watermark does.  Null texts are empty turns; turns are joined in their order by line feeds.
    """
    said = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))
    sessions = turns.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "call_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    return sessions.select("call_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), F.array_join(F.col("said")["text"], "\n").alias("text"))


def closed_spans(turns: DataFrame, gap: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(id, start, end, type, layer, score, surface): written identifiers of calls as they close."""
    return format_spans(closed_calls(turns, gap, late).select(F.col("call_id").alias("id"), "text"))


def action_counts(entries: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(since, action, n): audit entries (at, action) of a stream, counted in tumbling windows."""
    return entries.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), "action", "n")
