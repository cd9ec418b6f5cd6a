"""Calls shown while they go on: whatever order turns arrive in, what is shown at last is what whole calls give."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import live

SAID = [
    ("a", 0, 1, "may i have your full name"), ("a", 1, 1, "this is about Rahman"), ("a", 2, 1, "my name is rahman"), ("a", 2, 2, "my name is rahman bin ali."), ("a", 3, 1, "call 9123 4567 Rahman"),
    ("b", 0, None, "hello"), ("b", 1, 1, None), ("b", 5, 1, "mail me at ali.tan@mail.example"), ("b", 2, 3, "new words"), ("b", 2, 1, "old words"), (None, 0, 1, "nobody"),
]
SCHEMA = "call_id string, turn int, rev long, text string"


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_arrival_ends_alike(spark, tmp_path, seed):
    rows = list(SAID)
    random.Random(seed).shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    live.show_open_calls(stream, f"{tmp_path}/log", f"{tmp_path}/state", b"test", idle_minutes=None, availableNow=True).awaitTermination(240)
    log = spark.read.parquet(f"{tmp_path}/log").cache()
    last = {}
    for c, t, r, x in SAID:
        if c and (r or 0, x or "") >= last.get((c, t), (-1, "")):
            last[c, t] = (r or 0, x or "")
    whole = live.rendered_calls(spark.createDataFrame([(c, t, x) for (c, t), (_, x) in last.items()], "call_id string, turn int, text string"), b"test")
    got = {(r["call_id"], r["tier"], r["turn"]): r["text"] for r in live.shown(log).collect()}
    assert got == {(r["call_id"], r["tier"], r["turn"]): r["text"] for r in whole.collect()} and len(got) == 3 * len(last)
    assert "ahman" not in got["a", "GREEN", 1] and "ahman" in got["a", "RED", 1]
    shown = {}
    for r in sorted(log.collect(), key=lambda r: (r["seq"], r["op"])):  # every retraction takes back what was shown
        key = r["call_id"], r["tier"], r["turn"]
        if r["op"] == "retract":
            assert shown.pop(key) == r["text"]
        else:
            assert key not in shown
            shown[key] = r["text"]
    assert shown == got


def test_stale_revisions_are_dropped(spark):
    log = spark.createDataFrame([("a", t, 0, "hello there", 3, "show", 0) for t in ("RED", "AMBER", "GREEN")], live.LOG)
    old = spark.createDataFrame([("a", 2, 0, "hello")], live.REVISION)
    assert live.revise(old, log, b"k").count() == 0
    new = spark.createDataFrame([("a", 4, 0, "hello again"), ("a", 4, 1, "bye")], live.REVISION)
    got = sorted((r["tier"], r["turn"], r["op"], r["text"], r["seq"]) for r in live.revise(new, log, b"k").collect())
    assert got == sorted(x for t in ("RED", "AMBER", "GREEN") for x in ((t, 0, "retract", "hello there", 4), (t, 0, "show", "hello again", 4), (t, 1, "show", "bye", 4)))
    assert live.shown(log.unionByName(live.revise(new, log, b"k").withColumn("batch", F.lit(1)))).where("turn = 0").select("text").distinct().collect()[0][0] == "hello again"


def test_calls_that_rest_are_over(spark, tmp_path):
    import time

    spark.createDataFrame([("a", 0, 1, "one"), ("b", 0, 1, "x")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = live.revisions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), idle_minutes=0.05)
    query = stream.writeStream.outputMode("update").format("memory").queryName("open_calls").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for part, rest in ((None, 12), ([("a", 1, 1, "late"), ("c", 0, 1, "new")], 0)):
            if part:
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/1")
            until, want = time.time() + 60, 3 if part else 2
            while time.time() < until and spark.table("open_calls").count() < want:
                time.sleep(0.5)
            time.sleep(rest)
    finally:
        query.stop()
    assert sorted((r["call_id"], r["seq"], r["turn"]) for r in spark.table("open_calls").collect()) == [("a", 1, 0), ("b", 1, 0), ("c", 1, 0)]
