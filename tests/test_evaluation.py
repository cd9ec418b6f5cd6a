"""Proofs, intervals, alignment, rendering details, sources and streams, mostly against brute force."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import spoken
from spanloom.operators import access, audit, decisions, detect, metrics, ngrams, policy, render, spans
from spanloom.sources import transcripts as tr
from spanloom.streaming import turns as stream


def tree(hashes):
    """The root by splitting at the largest power of two below the size."""
    if len(hashes) == 1:
        return hashes[0]
    k = 1
    while k * 2 < len(hashes):
        k *= 2
    return hashlib.sha256(b"\x01" + bytes.fromhex(tree(hashes[:k])) + bytes.fromhex(tree(hashes[k:]))).hexdigest()


def leaf(i):
    return hashlib.sha256(b"\0" + f"entry{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def log(spark):
    rows = spark.createDataFrame([(i, f"entry{i}") for i in range(2050)], "pos long, entry string").repartition(3)
    return rows, audit.merkle_levels(rows.select("pos", audit.leaf_hash(F.col("entry")).alias("hash")))


def test_tree_over_block_edges(spark, log):
    _, levels = log
    assert levels[-1].collect()[0]["hash"] == tree([leaf(i) for i in range(2050)]) and len(levels) == 3
    assert audit.merkle_root(spark.createDataFrame([], "pos long, hash string")).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 1024, 1025, 2050])
def test_proofs_hold_and_others_do_not(log, size):
    _, levels = log
    root = tree([leaf(i) for i in range(size)])
    for pos in sorted({0, size // 3, size - 1}):
        proof = audit.inclusion_proof(levels, pos, size)
        assert audit.verify_inclusion(leaf(pos), pos, size, proof, root)
        assert not audit.verify_inclusion(leaf(pos + 1), pos, size, proof, root)
        assert size == 1 or not audit.verify_inclusion(leaf(pos), (pos + 1) % size, size, proof, root)
        assert not audit.verify_inclusion(leaf(pos), pos, size, [*proof, root], root) and not audit.verify_inclusion(leaf(pos), size, size, proof, root)
    for old in sorted({1, max(1, size // 2), size}):
        before = tree([leaf(i) for i in range(old)])
        proof = audit.consistency_proof(levels, old, size)
        assert audit.verify_consistency(old, size, before, root, proof)
        assert not audit.verify_consistency(old, size, tree([leaf(i + 1) for i in range(old)]), root, proof)


def test_small_proofs_in_full(spark):
    for size in (3, 6, 11):
        levels = audit.merkle_levels(spark.createDataFrame([(i, leaf(i)) for i in range(size)], "pos long, hash string"))
        root = tree([leaf(i) for i in range(size)])
        for pos in range(size):
            assert audit.verify_inclusion(leaf(pos), pos, size, audit.inclusion_proof(levels, pos, size), root)
        for old in range(1, size + 1):
            assert audit.verify_consistency(old, size, tree([leaf(i) for i in range(old)]), root, audit.consistency_proof(levels, old, size))


def test_heads_receipts_and_log(spark, log):
    rows, levels = log
    entries = rows.select(F.col("pos").alias("seq"), "entry", audit.leaf_hash(F.col("entry")).alias("hash"))
    roots = {n: tree([leaf(i) for i in range(n)]) for n in (5, 9)}
    heads = audit.publish_head(spark.createDataFrame([], "size long, root string"), 5, roots[5], [])
    heads = audit.publish_head(heads, 9, roots[9], audit.consistency_proof(levels, 5, 9))
    with pytest.raises(ValueError, match="extend"):
        audit.publish_head(heads, 12, roots[5], audit.consistency_proof(levels, 9, 12))
    for r in audit.receipts(entries, levels, 9, [0, 8], b"k"):
        assert audit.verify_receipt(r, b"k") and not audit.verify_receipt(r, b"other") and not audit.verify_receipt(r | {"entry": "else"}, b"k")
    good = [{"size": n, "root": r} for n, r in roots.items()]
    assert audit.verify_log(entries, F.col("entry"), good) == {"first_bad": None, "truncated_below": None, "first_bad_head": None}
    changed = F.when(F.col("seq") == 7, "x").otherwise(F.col("entry"))
    assert audit.verify_log(entries, changed, [*good, {"size": 9999, "root": ""}]) == {"first_bad": 7, "truncated_below": 9999, "first_bad_head": 9}


def test_exact_interval_equals_binomial_tails():
    for k, n in [(0, 5), (3, 7), (5, 5), (11, 100), (90, 100)]:
        low, high = metrics.clopper_pearson(k, n)
        tail = lambda p, ks: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in ks)
        assert (low == 0 and k == 0) or abs(tail(low, range(k, n + 1)) - 0.025) < 1e-9
        assert (high == 1 and k == n) or abs(tail(high, range(k + 1)) - 0.025) < 1e-9
    low, high = metrics.clopper_pearson(500_000, 1_000_000)
    assert 0.499 < low < 0.5 < high < 0.501


def test_spans_are_carried_over_changed_words(spark):
    ref, hyp = "my name is tan wei ming and i live in bedok", "my name is uh tan way ming i live in bedok lah"
    own = [{"start": 11, "end": 23, "type": "PERSON"}, {"start": 38, "end": 43, "type": "LOCATION"}, {"start": 24, "end": 27, "type": "GONE"}]
    df = spark.createDataFrame([(1, ref, hyp, own), (2, None, "x", None), (3, "", "", [])], "id long, ref string, hyp string, spans array<struct<start:int,end:int,type:string>>")
    got = {(r["type"], hyp[r["start"] : r["end"]]) for r in spans.carried_over(df).collect()}
    assert got == {("PERSON", "tan way ming"), ("LOCATION", "bedok")}


def test_scan_equals_the_patterns_alone(spark):
    draw = random.Random(3)
    texts = [(i, " ".join(draw.choices(["café", "a@b.co", "12", "345 678", "ÉCOLE", "x"], k=9))) for i in range(50)] + [(90, None), (91, "")]
    rules = [spans.Rule(r"\b\w+é\b", "A", "l", 1.0), spans.Rule(r"(\d+) (\d+)", "B", "m", 0.5, 2)]
    got = sorted(tuple(r)[:4] + (r["surface"],) for r in spans.scan_spans(spark.createDataFrame(texts, "id long, text string"), rules).collect())
    want = [(i, m.start(r.group), m.end(r.group), r.type, m.group(r.group)) for i, t in texts for r in rules for m in re.finditer(r.pattern, t or "")]
    assert got == sorted(want)


def test_masks_pseudonyms_and_pieces(spark):
    df = spark.createDataFrame([("0123-4567",), ("four five six seven eight",), ("no digits",), ("ling satu 9 nine two",)], "s string")
    assert [r[0] for r in df.select(spoken.mask_units(F.col("s"))).collect()] == ["****-4567", "* five six seven eight", None, "* satu 9 nine two"]
    texts = spark.createDataFrame([(1, "call 91234567 now\nor nine one two three four five six seven ok")], "id long, text string")
    found = spark.createDataFrame([(1, 5, 13, "PHONE", "format", 1.0), (1, 21, 59, "PHONE", "spoken", 1.0)], "id long, start int, end int, type string, layer string, score double")
    replaced = render.replacements(found, texts, policy.actions(spark), b"k")
    amber = [r["replacement"] for r in replaced.where("tier = 'AMBER'").orderBy("start").collect()]
    assert amber == ["<PHONE_1>", "<PHONE_1>"]  # one number, written and spoken
    pieces = render.rendered_pieces(texts, replaced).where("tier = 'AMBER'").first()["pieces"]
    assert [(p["text"], p["entity"] and p["entity"]["type"]) for p in pieces] == [("call ", None), ("<PHONE_1>", "PHONE"), (" now\nor ", None), ("<PHONE_1>", "PHONE"), (" ok", None)]
    turns = {r["turn"]: r["text"] for r in render.rendered_turns(render.render(texts, replaced)).where("tier = 'AMBER'").collect()}
    assert turns == {0: "call <PHONE_1> now", 1: "or <PHONE_1> ok"}


def test_spoken_amounts_are_banded_and_keys_are_counted(spark):
    texts = spark.createDataFrame([(1, "pay forty thousand dollars")], "id long, text string")
    found = spark.createDataFrame([(1, 4, 26, "AMOUNT", "spoken", 1.0)], "id long, start int, end int, type string, layer string, score double")
    green = render.replacements(found, texts, policy.actions(spark), b"k").where("tier = 'GREEN'").first()
    assert green["replacement"] == "between 10,000 and 100,000 dollars"
    many = spark.range(access.MOST_KEYS + 1).select(F.col("id").cast("string").alias("thief"), F.lit(b"k").alias("key"))
    with pytest.raises(ValueError, match="keys"):
        access.attack(spark.createDataFrame([], "id long, tier string, blob binary"), many)


def test_destinations_spoken_numbers_and_implausible_names(spark):
    turns = spark.createDataFrame([(1, 0, "client", "send it to my son in Jakarta"), (2, 0, "client", "i was in jakarta"), (3, 0, "client", "transfer abroad")], "call_id long, turn int, speaker string, text string")
    got = {r["id"]: (r["risk"], r["reason"]) for r in decisions.triage(turns, spark.createDataFrame([(1, 9000.0)], "id long, amount double")).collect()}
    assert got == {1: ("high", "large overseas transfer"), 2: ("low", "no high-risk transaction"), 3: ("low", "small overseas transfer")}
    texts = spark.createDataFrame([(1, "it is four five six seven okay"), (2, "only 12 here"), (3, "dia punya wei")], "id long, text string")
    assert [tuple(r) for r in decisions.residual_numbers(texts, spark.createDataFrame([], "id long, start int, end int")).collect()] == [(1, 6, 25)]
    named = spark.createDataFrame([(3, 0, 9, "PERSON", "context", 0.9), (3, 10, 13, "PERSON", "context", 0.9)], "id long, start int, end int, type string, layer string, score double")
    assert [r["start"] for r in detect.plausible(named, texts).collect()] == [10]


def test_files_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("c1", "s", "k", "a", "low", [("agent", "hi"), ("client", "hallo\nyou")], [(0, 2, "PERSON")])], tr.CALL_SCHEMA)
    tr.write_calls(calls, f"{tmp_path}/calls")
    assert tr.read_calls(spark, f"{tmp_path}/calls").collect() == calls.collect()
    assert [(r["turn"], r["speaker"]) for r in tr.turns_of(calls).collect()] == [(0, "agent"), (1, "client")]
    (tmp_path / "doc.json").write_text('{\n "a": [1,\n 2]\n}')
    assert tr.read_document(spark, f"{tmp_path}/doc.json").first()["a"] == [1, 2]
    spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "answer string, x int").write.parquet(f"{tmp_path}/p")
    assert [r[0] for r in tr.first_rows(f"{tmp_path}/p", spark, "answer", F.col("answer") != "a", 1).collect()] == ["b"]
    lines = spark.createDataFrame([(1, 1, "A: hi {{PERSON}}, {{OTP}} {{PERSON:Bo}} {{ODD}}")], "file int, n int, line string")
    filled = tr.fill_placeholders(lines, spark.createDataFrame([("PERSON", "Al"), ("OTP", "1")], "type string, value string"))
    assert filled.first()["line"] == "A: hi {{PERSON:Al}}, {{OTP:1}} {{PERSON:Bo}} {{ODD}}"
    done = tr.export_lines(spark.createDataFrame([(2, ["b"]), (1, ["a"])], "id long, utterances array<string>"), spark.createDataFrame([(1, 5, False), (2, 1, True)], "id long, k long, gated boolean"), f"{tmp_path}/x", "v")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/x/lines").collect()] == ['{"id":1,"utterances":["a"]}', '{"id":2,"utterances":["b"]}']
    assert (done["calls"], done["gated"], done["smallest_k"]) == (2, 1, 1)


def test_perplexity_of_the_words_in_spans(spark):
    texts = spark.createDataFrame([(1, "a b a c"), (2, "a b")], "id long, text string")
    counts = ngrams.model(texts)
    got = ngrams.span_perplexity(texts, spark.createDataFrame([(1, 2, 3, "X")], "id long, start int, end int, type string"), counts).first()
    p = 0.7 * 2 / 3 + 0.3 * (2 + 1) / (6 + 3)  # b after a: 2 of 3; b: 2 of 6 words, 3 kinds
    assert (got["type"], got["tokens"], got["perplexity"]) == ("X", 1, round(1 / p, 2))


def test_calls_leave_the_stream_when_they_are_over(spark, tmp_path):
    rows = [("c1", 0, "mail a@b.co", "2024-01-01 10:00:00"), ("c1", 1, "or 123456789", "2024-01-01 10:04:00"), ("c2", 0, "x", "2024-01-01 12:00:00"), ("c1", 2, "too late", "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, "call_id string, turn int, text string, at string").selectExpr("call_id", "turn", "text", "cast(at as timestamp) at")
    for i in range(4):
        df.offset(i).limit(1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = stream.closed_calls(source).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["call_id"]: r["text"] for r in spark.table("closed").collect()}["c1"] == "mail a@b.co\nor 123456789"
    found = stream.closed_spans(source).writeStream.format("memory").queryName("spans").outputMode("append").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    found.awaitTermination(120)
    assert {(r["id"], r["type"]) for r in spark.table("spans").collect()} == {("c1", "EMAIL"), ("c1", "ACCOUNT_NO")}
