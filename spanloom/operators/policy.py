"""Policy tables: what each type of data may look like for each tier."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import values as V


def types(spark: SparkSession) -> DataFrame:
    """(type, class, harm): a row per type."""
    harm = {c: h for c, h, *_ in V.CLASSES}
    return spark.createDataFrame([(t, c, harm[c]) for c, ts in V.TYPES.items() for t in ts], "type string, class string, harm int")


def class_actions(spark: SparkSession) -> DataFrame:
    """(class, tier, class_action)."""
    return spark.createDataFrame([(c, t, a) for c, _, *acts in V.CLASSES for t, a in zip(("RED", "AMBER", "GREEN"), acts, strict=True)], "class string, tier string, class_action string")


def overrides(spark: SparkSession) -> DataFrame:
    """(type, tier, type_action)."""
    return spark.createDataFrame(V.OVERRIDES, "type string, tier string, type_action string")


def actions(spark: SparkSession) -> DataFrame:
    """(type, class, harm, tier, action): a type's own action where it has one, else its class's."""
    every = types(spark).join(class_actions(spark), "class").join(overrides(spark), ["type", "tier"], "left")
    return every.select("type", "class", "harm", "tier", F.coalesce("type_action", "class_action").alias("action"))


def matrix(spark: SparkSession) -> DataFrame:
    """A row per type, a column per tier."""
    return actions(spark).groupBy("type", "class").pivot("tier", V.TIERS).agg(F.first("action"))


def version() -> str:
    """16 hex digits that change with the policy."""
    content = json.dumps([V.CLASSES, V.TYPES, V.OVERRIDES, V.RETENTION_DAYS, V.RELEASE_K], sort_keys=True)
    return hashlib.sha256(content.encode()).hexdigest()[:16]


def tier_rank(tier: Column) -> Column:
    """0 for GREEN to 2 for RED."""
    return F.array_position(F.array(*[F.lit(t) for t in V.TIERS]), tier) - 1


def overridden(actions_: DataFrame, variant: str) -> DataFrame:
    """actions under another policy: every action of the public tier replaced.

    ``all-suppress``, ``all-pseudonym`` and ``all-surrogate`` take one action for all types; ``keep-quasi`` keeps quasi-identifiers
    and sensitive attributes as they are.
    """
    if variant == "keep-quasi":
        action = F.when(F.col("class").isin("QUASI_ID", "SENSITIVE_ATTR"), "keep").otherwise(F.col("action"))
    elif variant in ("all-suppress", "all-pseudonym", "all-surrogate"):
        action = F.lit(variant.removeprefix("all-"))
    else:
        raise ValueError(f"unknown policy {variant}")
    return actions_.withColumn("action", F.when(F.col("tier") == "GREEN", action).otherwise(F.col("action")))
