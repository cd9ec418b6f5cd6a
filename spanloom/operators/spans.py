"""Spans as data: (id, start, end, type, layer, score), half-open character offsets into a text."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import values as V
from spanloom.functions.align import alignment
from spanloom.functions.batches import small_batches
from spanloom.functions.keyed import let
from spanloom.functions.offsets import running_sums
from spanloom.functions.phrases import Phrases, Prefilter, folded

SPAN = ["start", "end", "type", "layer", "score"]


def find_spans(texts: DataFrame, pattern: str, type_: str, layer: str, score: float, group: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Every match of a pattern in ``text``: keys, start, end, type, layer, score, surface.

    With ``group`` 1 the span is that group, which must end the match.  All native: texts are cut at the matches, and a
    match starts after all pieces and matches before it.
    """
    keys = keys or ["id"]
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    found = texts.where(F.col("text").rlike(pattern)).select(
        *keys, F.split("text", pattern, -1).alias("cut"), whole.alias("whole"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value")
    )
    before = running_sums(F.zip_with(F.slice("cut", F.lit(1), F.size("whole")), "whole", lambda c, w: F.length(c) + F.length(w)))
    match = F.arrays_zip(before.alias("before"), F.col("cut"), F.col("whole"), F.col("value"))
    each = found.select(*keys, F.explode(F.slice(match, F.lit(1), F.size("whole"))).alias("m"))
    end = F.col("m.before") + F.length("m.cut") + F.length("m.whole")
    return each.select(
        *keys, (end - F.length("m.value")).cast("int").alias("start"), end.cast("int").alias("end"),
        F.lit(type_).alias("type"), F.lit(layer).alias("layer"), F.lit(score).alias("score"), F.col("m.value").alias("surface"),
    ).where("start < end")


class Lexicon(NamedTuple):
    """Words and phrases, the preferred ones first, and the span that one of them makes as whole words in any case."""

    words: list[str]
    type: str
    layer: str
    score: float


class Rule(NamedTuple):
    """A pattern and the span that a match makes: its whole (group 0), or the group of that number."""

    pattern: str
    type: str
    layer: str
    score: float
    group: int = 0


def scan_spans(texts: DataFrame, rules: list[Rule], keys: list[str] | None = None, lexicons: list[Lexicon] | None = None) -> DataFrame:
    """Every match of every rule in ``text``, in one pass: keys, start, end, type, layer, score, surface, rule.

    ``rule`` is the number of the rule; those of lexicons follow those of patterns.  Patterns are Python's, as the
    detectors' rules are written: words and word edges are those of Unicode.  A text meets only the patterns of which it
    has a required literal, and only its lines with one where a pattern cannot go over a line feed.  Null texts have no spans; more columns than keys and ``text`` are ignored.
    """
    keys, lexicons = keys or ["id"], lexicons or []
    small_batches(texts.sparkSession)
    phrases = Phrases([x.words for x in lexicons])

    def rows(batches):
        compiled = [(re.compile(r.pattern), r.group) for r in rules]
        may, found = Prefilter([r.pattern for r in rules]), phrases.automaton()
        for batch in batches:
            at, start, end, rule, surface = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                low = folded(text) if text else ""
                for k, first, last in may.places(low) if text else ():
                    pattern, group = compiled[k]
                    for m in pattern.finditer(text, first, last):
                        if m.start(group) < m.end(group):
                            at.append(i), start.append(m.start(group)), end.append(m.end(group)), rule.append(k), surface.append(m.group(group))
                for k, x, y in found(low) if text else ():
                    at.append(i), start.append(x), end.append(y), rule.append(len(compiled) + k), surface.append(text[x:y])
            own = [batch.column(c).take(pa.array(at, type=pa.int64())) for c in keys]
            columns = [pa.array(x, type=pa.int32()) for x in (start, end, rule)]
            yield pa.RecordBatch.from_arrays([*own, *columns, pa.array(surface, type=pa.string())], [*keys, "start", "end", "rule", "surface"])

    named = texts.select(*keys, "text")
    schema = named.select(*keys).schema.add("start", "integer").add("end", "integer").add("rule", "integer").add("surface", "string")
    field = lambda name: F.get(F.array(*[F.lit(getattr(r, name)) for r in [*rules, *lexicons]]), F.col("rule")).alias(name)
    return named.mapInArrow(rows, schema).select(*keys, "start", "end", field("type"), field("layer"), field("score"), "surface", "rule")


def overlaps(a: str = "a", b: str = "b") -> Column:
    """Whether the spans of two aliases share a character."""
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def covered(spans: DataFrame, by: DataFrame, how: str = "left_semi", same_type: bool = False) -> DataFrame:
    """The spans that some span of ``by`` with the same id overlaps (``left_anti``: that none does)."""
    rule = (F.col("a.id") == F.col("b.id")) & overlaps()
    if same_type:
        rule = rule & (F.col("a.type") == F.col("b.type"))
    return spans.alias("a").join(by.alias("b"), rule, how)


def layer_rank(layer: Column) -> Column:
    """Trust of a layer; unknown ones rank as statistical recognition."""
    table = F.create_map(*[F.lit(x) for i, n in enumerate(V.LAYERS) for x in (n, i)])
    return F.coalesce(F.try_element_at(table, layer), F.lit(V.LAYERS.index("presidio")))


def merge(spans: DataFrame, harm: DataFrame) -> DataFrame:
    """Disjoint spans: every character goes to the best span that covers it, and runs of one winner are one span.

    Best is the most harmful type, then the most trusted layer, the longest, the highest score, and the first in
    ``input_pos`` (a column of spans that orders ties, without repeats within an id).  harm: (type, harm).
    """
    ranked = spans.join(F.broadcast(harm.select("type", "harm")), "type", "left").withColumn("harm", F.coalesce("harm", F.lit(0)))
    rank = F.struct(-F.col("harm"), -layer_rank(F.col("layer")), F.col("start") - F.col("end"), -F.col("score"), F.col("input_pos"))
    one = F.struct("start", "end", F.struct("input_pos", "type", "layer", "score", rank.alias("rank")).alias("w"))
    each = ranked.where("start < end").groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    return each.select("id", F.explode(disjoint(F.col("s"), lambda x: x["w"]["rank"])).alias("x")).select("id", "x.start", "x.end", "x.w.type", "x.w.layer", "x.w.score", "x.w.input_pos")


def disjoint(spans: Column, rank: Callable[[Column], Column]) -> Column:
    """Disjoint array<struct<start, end, w>> of an array<struct<start, end, w>> in order of start and end: the least rank is the best.

    Spans that overlap in a chain are one knot; most are one span, or have a best one that covers all others.  Boundaries of the spans of
    another knot cut it into elementary intervals; each takes the best of the spans that cover it.  ``w`` has an ``input_pos`` of its own.
    Null without spans.
    """

    def breaks(s: Column) -> Column:  # k spans begin before one; it begins a knot if they are the k that end first and have ended
        ended = lambda ends: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(ends, k - 1) <= F.get(s, k)["start"]))
        return let(F.array_sort(F.transform(s, lambda x: x["end"])), ended)

    def own(s: Column) -> Column:
        return let(breaks(s), lambda at: F.flatten(F.transform(at, lambda b, k: let(F.slice(s, b + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - b), knot))))

    def knot(s: Column) -> Column:
        ranked = F.transform(s, lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["w"].alias("w")))
        return F.when(F.size(s) == 1, s).otherwise(let(ranked, resolved))

    def resolved(s: Column) -> Column:
        whole = lambda x: F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["w"].alias("w")))
        covers = lambda x: (x["start"] == F.get(s, F.lit(0))["start"]) & (x["end"] == F.array_max(F.transform(s, lambda y: y["end"])))
        return let(F.array_min(s), lambda x: F.when(covers(x), whole(x)).otherwise(_untied(s)))

    return let(spans, lambda s: F.when(F.size(s) > 0, own(s)))


def _untied(knot: Column) -> Column:
    """Disjoint array<struct<start, end, w>> of a knot, array<struct<rank, start, end, w>>: the best span of each interval, and runs of one as one."""
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform(knot, lambda x: x["start"]), F.transform(knot, lambda x: x["end"]))))

    def won(cuts: Column) -> Column:
        best = lambda a, z: F.array_min(F.filter(knot, lambda x: (x["start"] <= a) & (z <= x["end"])))["w"]
        return F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda a, i: F.struct(a.alias("start"), best(a, F.get(cuts, i + 1)).alias("w")))

    def first(pieces: Column) -> Column:  # no interval of a knot is bare, so a run goes on to the next one
        return F.filter(pieces, lambda x, i: (i == 0) | (F.get(pieces, i - 1)["w"]["input_pos"] != x["w"]["input_pos"]))

    ended = lambda runs: F.transform(runs, lambda x, i: F.struct(x["start"], F.coalesce(F.get(runs, i + 1)["start"], F.array_max(F.transform(knot, lambda y: y["end"]))).alias("end"), x["w"]))
    return let(let(let(cuts, won), first), ended)


_SPACE = " \t\n\x0b\f\r"


def tidied(spans: Column, allowed: list[str]) -> Column:
    """Array of structs of SPAN and surface cut at line feeds, without edge white space, and without single characters, stop words and allowed words."""

    def lines(x: Column) -> Column:
        parts = F.split(x["surface"], "\n", -1)
        cut = F.arrays_zip(running_sums(F.transform(parts, lambda y: F.length(y) + 1)).alias("at"), parts.alias("line"))
        one = F.array(F.struct(F.lit(0).alias("at"), x["surface"].alias("line")))  # nearly all spans
        return F.transform(F.when(F.contains(x["surface"], F.lit("\n")), cut).otherwise(one), lambda y: piece(x, y["line"], x["start"] + y["at"]))

    def piece(x: Column, line: Column, at: Column) -> Column:
        lead = F.length(line) - F.length(F.ltrim(line, F.lit(_SPACE)))
        own = lambda start, text: F.struct(start.alias("start"), (start + F.length(text)).alias("end"), *[x[c].alias(c) for c in SPAN[2:]], text.alias("surface"))
        return let(F.btrim(line, F.lit(_SPACE)), lambda text: own(at + lead, text))

    word = lambda x: F.lower(F.btrim(x["surface"], F.lit(" .,?!")))
    keep = lambda x: let(word(x), lambda w: (F.length(w) > 1) & ~w.isin(*allowed, *V.STOP_WORDS))
    return F.filter(F.flatten(F.transform(spans, lines)), keep)


def coverage(spans: DataFrame) -> DataFrame:
    """(id, covered): characters that at least one span covers, from merged intervals."""
    order = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("reach", F.coalesce(reach, F.lit(0)))
    gain = F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))
    return fresh.groupBy("id").agg(F.sum(gain).cast("long").alias("covered"))


def pack_spans(spans: DataFrame) -> DataFrame:
    """(id, spans): one sorted array of structs for each id."""
    return spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*SPAN))).alias("spans"))


def word_spans(words: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, t0, t1, types): the times of spoken words (id, start, end, t0, t1) that spans touch: what to bleep.

    Neighbouring times that overlap or meet are one.
    """
    hit = words.alias("a").join(spans.alias("b"), (F.col("a.id") == F.col("b.id")) & overlaps()).select(F.col("a.id").alias("id"), "t0", "t1", "type")
    order = Window.partitionBy("id").orderBy("t0", "t1")
    reach = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hit.withColumn("run", F.coalesce((F.col("t0") > reach).cast("int"), F.lit(0))).withColumn("run", F.sum("run").over(order))
    return runs.groupBy("id", "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_sort(F.collect_set("type")).alias("types")).drop("run")


def carried_over(pairs: DataFrame) -> DataFrame:
    """(id, start, end, type): spans of a reference text laid over a hypothesis of it, word by word.

    pairs: (id, ref, hyp, spans), spans being array<struct<start, end, type>> into ref.  Words that the two texts have
    in common, in order, are aligned; a span covers in the hypothesis what stands between its first and last aligned
    words, and what replaces its words.  Spans of which no word has a place are left out.
    """

    def rows(batches):
        for batch in batches:
            out = []
            for key, ref, hyp, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "ref", "hyp", "spans")), strict=True):
                a, b = ([(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\S+", t or "")] for t in (ref, hyp))
                place = {k: (j + k - i, j + k - i + 1) if op in ("equal", "replace") else (j, j2) for op, i, i2, j, j2 in alignment([w for *_, w in a], [w for *_, w in b]) for k in range(i, i2)}
                for s in spans or []:
                    own = [place[k] for k, (x, y, _) in enumerate(a) if x < s["end"] and s["start"] < y and place[k][0] < place[k][1]]
                    if own:
                        out.append((key, b[min(p for p, _ in own)][0], b[max(q for _, q in own) - 1][1], s["type"]))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (batch.schema.field("id").type, pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["id", "start", "end", "type"])

    own = pairs.select("id", "ref", "hyp", "spans")
    return own.mapInArrow(rows, own.select("id").schema.add("start", "integer").add("end", "integer").add("type", "string"))


def aligned_words(pairs: DataFrame) -> DataFrame:
    """(id, op, ref_pos, hyp_pos, ref_word, hyp_word): what differs between the words of pairs (id, ref, hyp).

    op is replace, delete (missed by the hypothesis) or insert; of the words, small letters, one is null in the latter two.
    Words are runs of other than white space; null texts have none.
    """
    small_batches(pairs.sparkSession)

    def rows(batches):
        for batch in batches:
            out = []
            for key, ref, hyp in zip(*(batch.column(c).to_pylist() for c in ("id", "ref", "hyp")), strict=True):
                a, b = ((t or "").lower().split() for t in (ref, hyp))
                for op, i, i2, j, j2 in alignment(a, b):
                    if op != "equal":
                        for k in range(max(i2 - i, j2 - j)):
                            x, y = (i + k if i + k < i2 else None), (j + k if j + k < j2 else None)
                            out.append((key, op, x, y, None if x is None else a[x], None if y is None else b[y]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (batch.schema.field("id").type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ["id", "op", "ref_pos", "hyp_pos", "ref_word", "hyp_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names)

    own = pairs.select("id", "ref", "hyp")
    schema = own.select("id").schema.add("op", "string").add("ref_pos", "integer").add("hyp_pos", "integer").add("ref_word", "string").add("hyp_word", "string")
    return own.mapInArrow(rows, schema)
