"""Decisions on calls: risk triage, review holds, release by k-anonymity, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import spoken
from spanloom.functions import values as V
from spanloom.operators.render import REDACTED
from spanloom.operators.spans import covered


def triage(turns: DataFrame, amounts: DataFrame) -> DataFrame:
    """(id, risk, reason): the first rule that holds, of fraud cue, disclosed credential, large transfer abroad.

    A transfer is abroad by a cue of its own, or by a transfer word and a foreign destination anywhere in the call.

    turns: (call_id, turn, speaker, text); a disclosure is one client turn that names a credential and a giving verb
    and no negation.  amounts: (id, amount), any number of rows per call.
    """
    has = lambda words: spoken.says(F.col("low"), words)
    told = (F.col("speaker") == "client") & has(V.CREDENTIALS) & has(V.GIVING) & ~has(V.NEGATIONS)
    said = turns.select(F.col("call_id").alias("id"), "speaker", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    calls = said.groupBy("id").agg(
        F.max(has(V.FRAUD_CUES)).alias("fraud"), F.max(told).alias("told"), F.max(has(V.TRANSFER_CUES)).alias("cue"),
        F.max(has(V.TRANSFER_WORDS)).alias("moved"), F.max(has([p.lower() for p in V.FOREIGN_PLACES])).alias("place"),
    ).withColumn("abroad", F.col("cue") | (F.col("moved") & F.col("place")))
    top = amounts.groupBy("id").agg(F.max("amount").alias("top"))
    large = F.coalesce("top", F.lit(0.0)) >= V.TRANSFER_THRESHOLD
    reason = (
        F.when(F.col("fraud"), "fraud report").when(F.col("told"), "client disclosed a credential")
        .when(F.col("abroad") & large, "large overseas transfer").when(F.col("abroad"), "small overseas transfer").otherwise("no high-risk transaction")
    )
    return calls.join(top, "id", "left").select("id", F.when(F.col("fraud") | F.col("told") | (F.col("abroad") & large), "high").otherwise("low").alias("risk"), reason.alias("reason"))


def unanswered(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """Asked slots (id, type, start, end) in which no span of that type was found."""
    return covered(asked, spans, "left_anti", same_type=True)


def weak_spans(spans: DataFrame) -> DataFrame:
    """(id, weak): spans that only statistical recognition found, with a score that is too low."""
    return spans.where((F.col("layer") == "presidio") & (F.col("score") < V.MIN_NER_SCORE)).groupBy("id").agg(F.count("*").alias("weak"))


def residual_numbers(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, start, end): the first run of four digits or more, written or spoken, of each text that no span covers."""
    placed = spoken.placed_runs(texts, spoken.LONG_NUMBER)
    left = covered(placed, spans, "left_anti")
    return left.groupBy("id").agg(F.min(F.struct("start", "end")).alias("f")).select("id", "f.start", "f.end")


def qid_keys(replaced: DataFrame) -> DataFrame:
    """(id, qid): the sorted distinct quasi-identifiers (type, lower-case replacement) of each call."""
    quasi = replaced.where("class = 'QUASI_ID'")
    return quasi.groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "type", F.lower("replacement")))).alias("q")).select("id", F.array_join("q", "|").alias("qid"))


def k_gate(calls: DataFrame, k: int = V.RELEASE_K, person: str | None = None) -> DataFrame:
    """calls (id, qid) with k (the size of its class) and gated (a class that is too small; never without quasi-IDs).

    With ``person`` (a column) classes are measured in people, not calls.
    """
    unit = F.col("id") if person is None else F.col(person)
    size = calls.groupBy(F.col("qid").alias("class_qid")).agg(F.countDistinct(unit).alias("k"))
    small = (F.col("k") < k) & (F.coalesce("qid", F.lit("")) != "")
    return calls.join(size, F.col("qid").eqNullSafe(F.col("class_qid"))).select("id", "qid", "k", small.alias("gated"))


def suppress_gated(replaced: DataFrame, gated: DataFrame) -> DataFrame:
    """Replacements in which the quasi-identifiers of gated calls are suppressed."""
    hit = replaced.join(gated.where("gated").select("id", F.lit(True).alias("hit")), "id", "left")
    quasi = F.coalesce("hit", F.lit(False)) & (F.col("class") == "QUASI_ID")
    return hit.withColumn("replacement", F.when(quasi, REDACTED).otherwise(F.col("replacement"))).withColumn("action", F.when(quasi, "suppress").otherwise(F.col("action"))).drop("hit")


def required_k(attempts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(controls, motivation, harm, k): the class size that brings the risk below the threshold of the harm."""
    return attempts.crossJoin(F.broadcast(thresholds)).select("controls", "motivation", "harm", F.ceil(F.round(F.col("p") / F.col("threshold"), 6)).cast("long").alias("k"))


def expired(calls: DataFrame, at: Column) -> DataFrame:
    """Calls (created_at, risk) older than their risk's retention at a given time."""
    days = F.when(F.col("risk") == "high", V.RETENTION_DAYS["high"]).otherwise(V.RETENTION_DAYS["low"])
    return calls.where(F.col("created_at") < at - F.make_dt_interval(days))


def erase(keys: DataFrame, copies: DataFrame, calls: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys, copies and calls without those of ``gone`` (id); keys go first, so that no readable copy outlives its call."""
    left = lambda df: df.join(gone.select("id"), "id", "left_anti")
    return left(keys), left(copies), left(calls)


def learned_gaps(learned: DataFrame, spans: DataFrame, harm: DataFrame) -> DataFrame:
    """(id, types): types of quasi-identifiers and sensitive attributes that a learned recogniser names where no span is."""
    kinds = harm.where(F.col("class").isin("QUASI_ID", "SENSITIVE_ATTR")).select("type")
    missed = covered(learned.join(F.broadcast(kinds), "type", "left_semi"), spans, "left_anti")
    return missed.groupBy("id").agg(F.array_sort(F.collect_set("type")).alias("types"))


def release_reviewed(copies: DataFrame, approved: DataFrame) -> DataFrame:
    """copies (id, tier, state, policy) with the public copies of approved calls (id) released: they take the public policy."""
    yes = approved.select("id").distinct().withColumn("_yes", F.lit(True))
    freed = F.coalesce("_yes", F.lit(False)) & (F.col("tier") == "GREEN") & (F.col("state") == "held")
    joined = copies.join(yes, "id", "left")
    return joined.withColumns({"state": F.when(freed, "approved").otherwise(F.col("state")), "policy": F.when(freed, "tier:GREEN").otherwise(F.col("policy"))}).drop("_yes")


def release_risk(rates: DataFrame, attempts: DataFrame) -> DataFrame:
    """(controls, motivation, risk): re-identification rates (rate) times the probability p of an attempt, to 6 decimals."""
    return attempts.join(F.broadcast(rates)).select("controls", "motivation", F.round(F.col("rate") * F.col("p"), 6).alias("risk"))
