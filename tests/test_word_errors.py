"""Word errors are counted by alignment, not by a lambda for each word."""

from pyspark.sql import functions as F

from spanloom.operators import metrics


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_word_errors_without_a_lambda(spark):
    rows = spark.createDataFrame([("a b c", " A  x c d ", 2), ("", "a", 1), ("a", None, None)], "ref string, hyp string, n int")
    errors = rows.select(metrics.word_errors(F.col("ref"), F.col("hyp")).alias("got"), "n")
    assert all(r["got"] == r["n"] for r in errors.collect())
    assert "lambda" not in plan(errors)
