"""The training-data pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.functions.durable import durable
from spanloom.llm.stages import language_stage, mixing_stage, near_duplicate_stage, packing_stage, toxicity_stage

STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The first two stages are trained models: SQL can't express them.  tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, weights: DataFrame | None = None, block_bytes: int | None = None) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's rows are written and read again by the next.

    weights (source, weight): targets of the mixture; without them, the square root of each source's bytes.
    block_bytes: bytes of a block of the mixture; without it, it follows from the bytes of all documents.
    """
    docs, mix = spark.read.parquet(f"{sf_dir}/documents.parquet"), {"weights": weights, "block_bytes": block_bytes}
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir, **(mix if name == "source_mixing" else {})), name)
    return STAGES[-1][1](spark, docs, sf_dir, **mix)
