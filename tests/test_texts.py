"""Alignment, linkage and canaries against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import align
from spanloom.operators import metrics, ngrams, spans


def levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_alignment_has_the_fewest_edits_and_fits_together():
    rng = random.Random(3)
    for size in [*range(7)] * 40 + [60] * 20:
        a, b = (rng.choices("abcd", k=rng.randrange(size + 1)) for _ in "ab")
        steps = list(align.alignment(a, b))
        assert align.edits(steps) == levenshtein(a, b)
        built, x, y = [], 0, 0
        for op, i, i2, j, j2 in steps:
            assert (i, j) == (x, y) and (a[i:i2] == b[j:j2]) == (op == "equal") and (op != "replace" or i2 - i == j2 - j)
            built, x, y = built + b[j:j2], i2, j2
        assert built == b and (x, y) == (len(a), len(b))
    long = [str(i) for i in range(20_000)]
    other = [w for i, w in enumerate(long) if i % 500]
    assert align.edits(align.alignment(long, other)) == 40


def test_aligned_words_agree_with_word_errors(spark):
    rng = random.Random(9)
    data = [(i, " ".join(rng.choices(["so", "The", "cat", "a"], k=rng.randrange(1, 12))), " ".join(rng.choices(["so", "the", "dog", "a"], k=rng.randrange(1, 12)))) for i in range(150)] + [(999, None, "x"), (998, "", None)]
    pairs = spark.createDataFrame(data, "id long, ref string, hyp string")
    got = {r["id"]: r["n"] for r in spans.aligned_words(pairs).groupBy("id").agg(F.count("*").alias("n")).collect()}
    want = {r["id"]: r["e"] for r in pairs.where("id < 900").select("id", metrics.word_errors(F.col("ref"), F.col("hyp")).alias("e")).collect()}
    assert {i: n for i, n in got.items() if i < 900} == {i: n for i, n in want.items() if n} and got[999] == 1 and 998 not in got


@pytest.mark.parametrize("most", [64, 1, 0])
def test_linkage_equals_a_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(ngrams, "COMBINATIONS", most)
    rng = random.Random(most)
    pool = {"nation": ["united kingdom", "kingdom", "peru", None, ""], "job": ["nurse", "night nurse", "clerk"], "town": ["rio", "oslo", "new york"]}
    people = [(i, *[rng.choice(pool[a]) for a in pool]) for i in range(60)]
    texts = [(i, " ".join(rng.choices(["from", "United Kingdom,", "peru!", "night", "nurse", "clerk", "new", "york", "Rio", "of oslo"], k=rng.randrange(8)))) for i in range(50)] + [(90, None), (91, "nobody")]
    got = ngrams.linkage(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(people, "person long, nation string, job string, town string"), list(pool))
    got = {r["id"]: (r["active"], r["candidates"], r["first"]) for r in got.collect()}
    want = {}
    for i, text in texts:
        low = " " + " ".join("".join(c if c.isalnum() or c in " _" else " " for c in (text or "").lower()).split()) + " "
        named = {a: {v for v in vs if v and f" {v} " in low} for a, vs in pool.items()}
        named = {a: {v for v in vs if any(p[1 + k] == v for p in people)} for k, (a, vs) in enumerate(named.items())}
        if any(named.values()):
            fits = [p[0] for p in people if all(not vs or p[1 + k] in vs for k, vs in enumerate(named.values()))]
            want[i] = (sum(map(bool, named.values())), len(fits), min(fits, default=None))
    assert got == want


def test_planted_canaries_and_trie_scores(spark):
    texts = spark.createDataFrame([(i, f"hello caller number {i % 7} how are you") for i in range(60)], "id long, text string")
    canaries = spark.createDataFrame([("c1", "my pin is 4 7 2", 12), ("c2", "code 9 9 1", 1), ("c3", "never", 0)], "canary string, said string, times int")
    out = ngrams.planted(texts, canaries.where("times > 0"), b"k").collect()
    assert len(out) == 60 and sum(r["text"].endswith("\nmy pin is 4 7 2") for r in out) == 12 and sum(r["text"].endswith("\ncode 9 9 1") for r in out) == 1
    model = ngrams.model(spark.createDataFrame([tuple(r) for r in out], "id long, text string"))
    digits = ["".join(x) for x in itertools.product("0123456789", repeat=3)]
    every = [("c1", d == "472", "my pin is " + " ".join(d)) for d in digits] + [("c3", True, ""), ("c3", False, "pin")]
    scores = ngrams.candidate_scores(spark.createDataFrame(every, "canary string, planted boolean, said string"), model).cache()
    alone = spark.createDataFrame([(said,) for *_, said in every], "said string")
    toks = ngrams.bigrams(alone.select(F.col("said").alias("id"), F.col("said").alias("text")))
    want = {r["id"]: r["s"] for r in ngrams.log_probabilities(toks, model).groupBy("id").agg(F.sum("logp").alias("s")).collect()}
    assert scores.count() == len(every) and all(math.isclose(r["logp"], want.get(r["said"], 0.0), rel_tol=1e-9, abs_tol=1e-9) for r in scores.collect())
    exposed = {r["canary"]: r["exposure"] for r in ngrams.exposure(scores).collect()}
    assert exposed["c1"] == round(math.log2(1000), 4)


def test_a_scope_deletes_what_was_written_inside(spark):
    from spanloom.functions import durable

    with durable.scope(spark):
        path = durable.new_path(spark, "outer")
        spark.range(3).write.parquet(path)
        with durable.scope(spark):
            inner = durable.durable(spark.range(5), "inner")
            where = inner.inputFiles()[0].rsplit("/", 1)[0]
            assert inner.count() == 5
        assert not durable.path_exists(spark, where) and durable.path_exists(spark, path)
    assert not durable.path_exists(spark, path)
    with pytest.raises(ValueError), durable.scope(spark):
        kept = durable.durable(spark.range(2), "kept")
        raise ValueError
    assert kept.count() == 2
