"""What one task holds doesn't grow with the input."""

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import batches
from spanloom.operators import metrics, tagger


def test_scored_spans_are_dealt_to_more_tasks_the_more_there_are(spark, monkeypatch):
    monkeypatch.setattr(metrics, "dealt", partial(batches.dealt, rows=50))
    cols = "id long, start int, end int, type string, harm int"
    gold = spark.createDataFrame([(i % 400, i // 400 * 10, i // 400 * 10 + 4, "OTP", 10) for i in range(1_000)], cols)
    found = gold.where("id % 2 = 0").drop("harm")
    scored = metrics.per_span(gold, found)
    assert scored.select(F.spark_partition_id().alias("p")).distinct().count() > 15
    got = scored.collect()
    assert len(got) == 1_000 and all(r["hit"] == r["strict"] == r["type_ok"] == (r["id"] % 2 == 0) for r in got)


def test_dealt_keeps_all_rows_and_meets_by_key(spark):
    many, none = spark.range(120).withColumn("x", F.lit(1)), spark.range(0).withColumn("y", F.lit(1))
    a, b = batches.dealt("id", many, none, rows=10)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 12 and a.count() == 120
    assert batches.dealt("id", none, many)[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_are_dealt_to_the_tagger(spark, monkeypatch):
    monkeypatch.setattr(tagger, "TASK_TEXTS", 10, raising=False)
    model = tagger.Tagger(tagger.TYPES, np.zeros((tagger.BUCKETS + 10, 9)))
    model.weights[tagger.features(["Tan"])[0, 1], 1] = 9.0
    texts = spark.range(200).coalesce(1).select("id", F.lit("i am Tan").alias("text"))
    found = tagger.recognised(texts, model)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 10 and found.count() == 200
