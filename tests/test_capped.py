"""Capped counts: what each list gives to the shuffle, and that nothing else is chosen."""

from pyspark.sql import functions as F

from spanloom.operators import ngrams

KEY = b"a key for tests only"


def test_lists_are_cut_before_the_shuffle_and_choose_what_all_tokens_choose(spark):
    rows = [(i % 7, " ".join(f"w{(i * 31 + k * k) % 97}" for k in range(i % 90))) for i in range(60)] + [(3, None), (8, ""), (None, "a b a")]
    texts = spark.createDataFrame(rows, "id long, text string")
    pairs = ngrams.bigrams(texts).select("id", F.concat_ws(" ", "a", "b").alias("tok"))
    for lists, toks in ((ngrams.word_lists(texts), ngrams.tokens(texts).where("pos > 0")), (ngrams.pair_lists(texts), pairs)):
        got, want = ngrams.capped_lists(lists, 5, KEY), ngrams.capped(toks, 5, KEY)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 30
    plan = ngrams.capped_lists(ngrams.word_lists(texts), 5, KEY)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("AdaptiveSparkPlan")[-1].count("Exchange hashpartitioning") == 1 and "slice(" in plan.split("Exchange hashpartitioning")[1]
