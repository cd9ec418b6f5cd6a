"""Calls that several measures read are made once."""

from spanloom.plans import evaluation


def test_gold_spans_come_from_written_calls(spark):
    texts, gold, found = evaluation.gold_and_found(spark, "/root/testdata/sf0.001")
    for made in (texts, gold, found):
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert gold.count() == 2 * texts.count() > found.count() > 0
