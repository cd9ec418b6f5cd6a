"""Whole calls are read once: a call stays one row from its turns to its spans."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import decisions, detect, ingest, policy, render, spans

PARTS = [
    "my name is uh Tan Ah Kow", "um i am Lim and i live in uh Bedok", "otp is um 123456", "one two three four five six", "my account number is uh zero one two three four five six seven",
    "card 4000000008292831", "nric S1234567D", "pay two thousand dollars", "wei dot ming at mail dot com", "mail me at a@b.sg", "what is your pin", "can you read me the otp please", "four two seven one",
    "it's uh four double two 7", "what is your mother's maiden name", "it was um Goh lah", "tan said otp 123456 again", "erm", "", "012-345678-9", "please tell me your account number", "İ Kow lim", "okay lah",
]


def made_calls(n=300, seed=5):
    rng = random.Random(seed)
    return [(k, t, rng.choice(PARTS) if rng.random() < 0.97 else None) for k in range(n) for t in range(rng.randrange(1, 9))]


def test_detection_shuffles_nothing_once_calls_are_written(spark):
    turns = spark.createDataFrame(made_calls(20), "call_id int, turn int, text string")
    _, texts = detect.written(detect.gathered(turns))
    found = detect.detect(turns, texts=texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 20
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_one_pass_gives_what_the_layers_give(spark):
    turns = spark.createDataFrame(made_calls(), "call_id int, turn int, text string")
    turns, texts = detect.written(detect.gathered(turns))
    each = detect.found(texts).select("id", "text", F.explode("found").alias("x")).select("id", "text", "x.*")
    assert each.where(F.col("surface") != F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))).count() == 0
    got = {tuple(r) for r in each.select("id", *spans.SPAN).collect()}
    layers = [detect.format_spans(texts), detect.cue_spans(texts), detect.lexicon_spans(texts), detect.spoken_spans(texts), detect.dialogue_spans(turns)]
    want = {tuple(r) for x in layers for r in x.select("id", *spans.SPAN).collect()}
    assert got == want and {x[4] for x in want} == {"format", "context", "spoken", "dialogue"} and len(want) > 900


def test_rendering_keeps_a_call_one_row(spark):
    turns = spark.createDataFrame([*made_calls(60), (900, 0, "an American named Tan Ah Kow called tan ah kow"), (901, 0, None)], "call_id int, turn int, text string")
    _, texts = detect.written(detect.gathered(turns))
    calls = detect.detect_calls(texts)
    actions = spark.createDataFrame(policy.actions(spark).collect(), policy.actions(spark).schema)  # the policy's own joins are no call's
    shown = render.render_calls(calls, actions, b"k")
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    rows = detect.each_span(calls).select("id", *spans.SPAN)
    want = render.render(texts, render.replacements(rows, texts, policy.actions(spark), b"k"))
    got = {tuple(r) for r in shown.collect()}
    assert got == {tuple(r) for r in want.select("id", "tier", "text").collect()} and len(got) == 3 * 62


def test_reasons_for_review_are_those_of_the_rules(spark):
    turns = spark.createDataFrame(made_calls(120, 8), "call_id int, turn int, text string")
    turns, texts = detect.written(detect.gathered(turns))
    calls = detect.detect_calls(texts, layers=["format", "context"])
    rows = detect.each_span(calls)
    got = {(r["id"], w) for r in ingest.review_reasons(calls.join(texts.select("id", "said"), "id")).collect() for w in r["reasons"]}
    size = F.length(F.coalesce("text", F.lit("")))
    at = F.coalesce(F.sum(size + 1).over(Window.partitionBy("call_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    asked = detect.slot_asks(turns.withColumn("start", at), ["start"]).select(F.col("call_id").alias("id"), "type", "start", (F.col("start") + size).alias("end"))
    want = {(r["id"], "no " + r["type"]) for r in decisions.unanswered(asked, rows).collect()} | {(r["id"], "number") for r in decisions.residual_numbers(texts, rows).collect()}
    assert got == want and {"no OTP", "no PIN", "number"} <= {w for _, w in got}
