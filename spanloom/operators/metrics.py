"""Evaluation: how much was found, how sure that is, and what was missed."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from spanloom.functions import keyed
from spanloom.functions.align import alignment, edits
from spanloom.functions.batches import dealt
from spanloom.functions.offsets import running_sums
from spanloom.operators.spans import coverage, overlaps


def per_span(gold: DataFrame, found: DataFrame) -> DataFrame:
    """gold (id, start, end, type, harm) with hit (overlapped), strict (equal offsets and type) and type_ok.

    Equal gold rows count once.  Both are dealt out by id, to more tasks the more gold spans there are.
    """
    gold, found = dealt("id", gold, found)
    pairs = gold.alias("a").join(found.alias("b"), (F.col("a.id") == F.col("b.id")) & overlaps(), "left")
    hit = F.col("b.id").isNotNull()
    strict = hit & (F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end")) & (F.col("a.type") == F.col("b.type"))
    keys = [F.col(f"a.{c}").alias(c) for c in gold.columns]
    return pairs.groupBy(*keys).agg(F.max(hit).alias("hit"), F.max(F.coalesce(strict, F.lit(False))).alias("strict"), F.max(F.coalesce(F.col("a.type") == F.col("b.type"), F.lit(False))).alias("type_ok"))


def ratio(part: Column, whole: Column) -> Column:
    """Four decimals; null if there is nothing to divide by."""
    return F.round(part / F.nullif(whole, F.lit(0)), 4)


def recall(spans: DataFrame, by: list[str] | None = None, weight: str = "harm") -> DataFrame:
    """n, recall, weighted recall, strict recall and type accuracy of scored gold spans, overall or by columns."""
    one = lambda c: F.sum(F.col(c).cast("int"))
    return spans.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), ratio(one("hit"), F.count("*")).alias("recall"),
        ratio(F.sum(F.when(F.col("hit"), F.col(weight)).otherwise(0)), F.sum(weight)).alias("weighted_recall"),
        ratio(one("strict"), F.count("*")).alias("strict_recall"), ratio(one("type_ok"), one("hit")).alias("type_accuracy"),
    )


def span_scores(gold: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, gold_chars, hidden_chars, found_chars, over_chars, found_n, right_n, tp, fp, fn): additive counts of each text (id, text).

    Characters of gold spans that found spans cover or don't, of found spans outside gold; found spans that overlap gold;
    and the words (runs of other than white space) that are in both, in found only, or in gold only.
    """
    words = texts.select("id", F.split("text", r"\s+", -1).alias("w"), F.regexp_extract_all("text", F.lit(r"\s+"), F.lit(0)).alias("gap"))
    at = running_sums(F.zip_with("w", "gap", lambda w, g: F.length(w) + F.coalesce(F.length(g), F.lit(0))))
    each = words.select("id", F.explode(F.zip_with(at, F.transform("w", F.length), lambda a, n: F.struct(a.alias("start"), (a + n).alias("end")))).alias("x"))
    tokens = each.select("id", "x.start", "x.end").where("start < end")
    inside = lambda spans, name: tokens.alias("a").join(spans.alias("b"), (F.col("a.id") == F.col("b.id")) & overlaps(), "left_semi").withColumn(name, F.lit(1))
    marked = inside(gold, "g").join(inside(found, "f"), ["id", "start", "end"], "full").na.fill(0, ["g", "f"])
    by_word = marked.groupBy("id").agg(F.sum(F.col("g") * F.col("f")).alias("tp"), F.sum((1 - F.col("g")) * F.col("f")).alias("fp"), F.sum(F.col("g") * (1 - F.col("f"))).alias("fn"))
    g, f = (coverage(x).withColumnRenamed("covered", n) for x, n in ((gold, "gold_chars"), (found, "found_chars")))
    both = coverage(gold.select("id", "start", "end").unionByName(found.select("id", "start", "end"))).withColumnRenamed("covered", "any_chars")
    right = found.alias("a").join(gold.alias("b"), (F.col("a.id") == F.col("b.id")) & overlaps(), "left_semi").groupBy("id").agg(F.count("*").alias("right_n"))
    every = texts.select("id")
    for part in (g, f, both, found.groupBy("id").agg(F.count("*").alias("found_n")), right, by_word):
        every = every.join(part, "id", "left")
    every = every.na.fill(0)
    hidden = F.col("gold_chars") + F.col("found_chars") - F.col("any_chars")
    return every.select("id", "gold_chars", hidden.alias("hidden_chars"), "found_chars", (F.col("found_chars") - hidden).alias("over_chars"), "found_n", "right_n", "tp", "fp", "fn")


def summary(scores: DataFrame, chars: DataFrame) -> DataFrame:
    """(precision, char_leakage, over_redaction, token_f1) of span_scores, with chars (id, n): the length of each text.

    Leakage is the share of gold characters that stay readable, over-redaction the share of all others that are hidden.
    """
    every = scores.join(chars, "id")
    return every.agg(
        ratio(F.sum("right_n"), F.sum("found_n")).alias("precision"), ratio(F.sum(F.col("gold_chars") - F.col("hidden_chars")), F.sum("gold_chars")).alias("char_leakage"),
        ratio(F.sum("over_chars"), F.sum(F.col("n") - F.col("gold_chars"))).alias("over_redaction"),
        ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("token_f1"),
    )


def redaction_grade(gold: DataFrame, rendered: DataFrame) -> DataFrame:
    """(type, hidden, partly, released): gold spans (id, type, surface) by how much of them a rendered text still shows.

    rendered (id, text).  Released: the whole surface can be read in the text; partly: a word of it of three or more
    letters or digits can; hidden: none.  It is measured on the text that is shown, so an action that changes nothing
    hides nothing.
    """
    low = F.lower("text")
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"(?U)[^\w]+", " "), F.lit(" "))
    has = lambda c: F.contains(padded(low), padded(c))
    words = F.filter(F.split(F.lower("surface"), r"(?U)[^\w]+"), lambda w: F.length(w) >= 3)
    part = F.exists(words, lambda w: F.contains(padded(low), F.concat(F.lit(" "), w, F.lit(" "))))
    grade = F.when(has(F.lower("surface")), "released").when(part, "partly").otherwise("hidden")
    graded = gold.join(rendered, "id").select("type", grade.alias("grade"))
    return graded.groupBy("type").agg(*[F.count_if(F.col("grade") == g).alias(g) for g in ("hidden", "partly", "released")])


def review_effect(spans: DataFrame, held: DataFrame) -> DataFrame:
    """(calls_held, recall, recall_after, leaks_left): scored gold spans (id, harm, hit) if calls in held (id) are put right by a person."""
    every = spans.join(held.select("id").distinct().withColumn("held", F.lit(True)), "id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    found = lambda ok: ratio(F.sum(F.when(ok, F.col("harm")).otherwise(0)), F.sum("harm"))
    calls = F.count_distinct(F.when(F.col("held"), F.col("id")))
    return every.agg(calls.alias("calls_held"), found(F.col("hit")).alias("recall"), found(F.col("hit") | F.col("held")).alias("recall_after"), F.count_if(~F.col("hit") & ~F.col("held")).alias("leaks_left"))


def deployable(old_wer: Column, new_wer: Column, raw_wer: Column) -> Column:
    """Whether a model trained on released text may replace the old one: better than it, and at most a point worse than raw."""
    return (new_wer < old_wer) & (new_wer <= raw_wer + 0.01)


def dataset_summary(calls: DataFrame, turns: DataFrame, spans: DataFrame) -> DataFrame:
    """(calls, turns, words, spans, types) of a corpus: calls (id), turns (text), spans (type)."""
    n = calls.agg(F.count("*").alias("calls"))
    said = turns.agg(F.count("*").alias("turns"), F.sum(F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))).cast("long").alias("words"))
    return n.join(F.broadcast(said)).join(F.broadcast(spans.agg(F.count("*").alias("spans"), F.count_distinct("type").alias("types"))))


def word_categories(missed: DataFrame, categories: list[tuple[str, str]]) -> DataFrame:
    """(category, n) of missed words (word): the first category whose pattern matches; ``other`` if none does."""
    word = F.lower("word")
    kind = F.coalesce(*[F.when(word.rlike(pattern), name) for name, pattern in categories], F.lit("other"))
    return missed.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def shape_kept(surface: Column, replacement: Column) -> Column:
    """Whether a replacement has the digits of a surface in the same places, measured on the texts."""
    shape = lambda c: F.regexp_replace(c, r"[0-9]", "9")
    return shape(surface).eqNullSafe(shape(replacement))


def entity_recall(spans: DataFrame) -> DataFrame:
    """(type, entities, entity_recall): entities (id, type, key) all of whose mentions were found."""
    whole = spans.groupBy("id", "type", "key").agg(F.min("hit").alias("all_hit"))
    return whole.groupBy("type").agg(F.count("*").alias("entities"), ratio(F.count_if("all_hit"), F.count("*")).alias("entity_recall"))


def misses(spans: DataFrame, per_type: int = 4) -> DataFrame:
    """The first missed spans of each type."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy("id", "start", "end"))
    return spans.where("not hit").withColumn("n", rank).where(F.col("n") <= per_type).select("type", "n", "id", "start", "end")


def confusion(rows: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    """Counts of guesses (columns) for each truth (rows)."""
    return rows.groupBy(truth).pivot(guess, labels).agg(F.count(F.lit(1))).na.fill(0)


def agreement(rows: DataFrame, truth: str, guess: str, positive) -> DataFrame:
    """(n, accuracy, positives, recall, low, high): how often a guess is right, and how many positives it finds.

    low and high are the exact 95% interval of the recall; recall is null without positives.  Rows without a truth don't
    count; a missing guess is wrong.
    """
    right = F.coalesce(F.col(truth) == F.col(guess), F.lit(False))
    held = F.col(truth) == F.lit(positive)
    sums = rows.where(F.col(truth).isNotNull()).agg(F.count("*").alias("n"), F.count_if(right).alias("_right"), F.count_if(held).alias("positives"), F.count_if(held & right).alias("_found"))
    bounds = F.udf(lambda k, n: clopper_pearson(k, n) if n else None, "struct<low double, high double>")  # of one row
    each = sums.withColumn("_b", bounds("_found", "positives"))
    return each.select("n", ratio(F.col("_right"), F.col("n")).alias("accuracy"), "positives", ratio(F.col("_found"), F.col("positives")).alias("recall"), F.round("_b.low", 4).alias("low"), F.round("_b.high", 4).alias("high"))


def targets(measured: DataFrame, wanted: DataFrame) -> DataFrame:
    """(target, value, bound, met) of what is wanted (target, bound, at_least), from what was measured (target, value).

    A target that was measured several times is met if all its values meet it, and the one that is furthest off is shown;
    one that wasn't measured has neither value nor verdict.
    """
    both = wanted.join(measured, "target", "left")
    margin = F.when(F.col("at_least"), F.col("value") - F.col("bound")).otherwise(F.col("bound") - F.col("value"))
    worst = both.groupBy("target").agg(F.min(F.when(margin.isNotNull(), F.struct(margin.alias("margin"), "value"))).alias("w"), F.first("bound").alias("bound"))
    return worst.select("target", F.col("w.value").alias("value"), "bound", (F.col("w.margin") >= 0).alias("met"))


#: Poisson(1) counts up to 9 as cuts of a 28-bit number: a draw is the number of cuts that it reaches.
POISSON_CUTS = [int((1 << 28) * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(9)]


def resampled(rows: DataFrame, resamples: int, key: bytes) -> DataFrame:
    """rows (key, ...) once for each resample, with ``times``, how often the resample takes the row: a keyed Poisson draw.

    A resample of a large table takes each row a Poisson number of times, independently of the others; so no row needs
    a position, nothing is joined, and sums are combined before the shuffle.  One MAC serves eight resamples.
    """
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // 8))))
    macs = blocks.withColumn("_mac", keyed.hmac_sha256(key, F.concat_ws("|", F.col("key").cast("string"), F.col("_block").cast("string"))))
    each = macs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("resample", F.col("_block") * 8 + F.col("_part")).where(F.col("resample") < resamples)
    draw = keyed.keyed_int(F.col("_mac"), F.col("_part") * 7)
    times = sum(((draw >= c).cast("int") for c in POISSON_CUTS), F.lit(0))
    return each.withColumn("times", times).drop("_block", "_mac", "_part")


def bootstrap(rows: DataFrame, resamples: int, key: bytes) -> DataFrame:
    """(low, high): the 95% interval of sum(num) / sum(den) over resamples of rows (key, num, den): the values at 2.5 % and
    97.5 % of the sorted ones.  Rows with an equal key are taken together."""
    total = lambda c: F.sum(F.col("times") * F.col(c))
    values = resampled(rows, resamples, key).groupBy("resample").agg((total("num") / F.nullif(total("den"), F.lit(0))).alias("v"))
    ordered = values.agg(F.array_sort(F.collect_list("v")).alias("v"))  # a value per resample
    low = int(resamples * 0.025)
    return ordered.select(F.round(F.get("v", F.lit(low)), 4).alias("low"), F.round(F.get("v", F.lit(resamples - 1 - low)), 4).alias("high"))


def paired_bootstrap(rows: DataFrame, resamples: int, key: bytes) -> DataFrame:
    """(mean_gain, p): how often the second arm isn't better, over equal resamples of (key, num_a, num_b, den)."""
    total = lambda c: F.sum(F.col("times") * F.col(c))
    gain = resampled(rows, resamples, key).groupBy("resample").agg(((total("num_b") - total("num_a")) / F.nullif(total("den"), F.lit(0))).alias("g"))
    return gain.agg(F.round(F.avg("g"), 4).alias("mean_gain"), F.round(F.avg((F.col("g") <= 0).cast("int")), 4).alias("p"))


def _beta_below(x: float, a: float, b: float) -> float:
    """The beta distribution function, by its continued fraction in logarithms."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_below(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, value, m = 1e-300, 1.0, 0.0, 1.0, 0
    while m < 10_000:
        half = m // 2
        if m == 0:
            step = 1.0
        elif m % 2 == 0:
            step = half * (b - half) * x / ((a + m - 1) * (a + m))
        else:
            step = -(a + half) * (a + b + half) * x / ((a + m - 1) * (a + m))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        value *= (factor := c * d)
        m += 1
        if m > 2 and abs(factor - 1) < 1e-15:
            break
    return front * (value - 1)


def beta_quantile(share: float, a: float, b: float) -> float:
    """Where the beta distribution function reaches a share: narrowed down on the scale of log-odds."""
    low, high = -700.0, 700.0
    while high - low > 1e-13 * max(1.0, abs(low)):
        middle = (low + high) / 2
        below = _beta_below(1 / (1 + math.exp(-middle)), a, b) < share
        low, high = (middle, high) if below else (low, middle)
    return 1 / (1 + math.exp(-high))


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval of a share k of n: quantiles of beta distributions."""
    tail = (1 - level) / 2
    return (beta_quantile(tail, k, n - k + 1) if k else 0.0, beta_quantile(1 - tail, k + 1, n - k) if k < n else 1.0)


def rates(spans: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """(type, n, per_1000): the most frequent types per 1000 words of words (n_words)."""
    total = words.agg(F.sum("n_words").alias("w"))
    counts = spans.groupBy("type").agg(F.count("*").alias("n")).join(F.broadcast(total))
    return counts.select("type", "n", F.round(F.col("n") * 1000 / F.col("w"), 4).alias("per_1000")).orderBy(F.desc("n"), "type").limit(n)


def word_errors(ref: Column, hyp: Column) -> Column:
    """Word edits that turn one text into another, by alignment; null for a null text."""
    words = lambda text: F.regexp_replace(F.lower(F.trim(text)), r"\s+", "\n")
    return _word_edits(words(ref), words(hyp))


@F.arrow_udf(IntegerType())
def _word_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edits between texts of one word a line."""
    pairs = zip(ref.to_pylist(), hyp.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else edits(alignment(a.split("\n"), b.split("\n"))) for a, b in pairs], type=pa.int32())
