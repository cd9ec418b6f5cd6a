"""URL rules by a sort-merge range join.

A host's labels in reverse order, each ended by a dot, make a key in which a host and all its subdomains form one
interval.  URLs are sorted by key; rules open an interval at their own key.  One sweep over the sorted rows keeps the
rules whose intervals are open on a stack: nested rules lie above those that contain them, and the stack holds exactly
the rules whose host fits the URL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.batches import small_batches

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``m.example.net`` as ``net.example.m.``: the key of a host begins with the key of every parent domain."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _cuts(keys: DataFrame, parts: int, sample: int) -> list[str]:
    """At most ``parts - 1`` keys that cut the sorted rows into near equal runs, from at most ``sample`` sampled keys."""
    rows = keys.count()
    if rows == 0 or parts < 2:
        return []
    draw = F.pmod(F.xxhash64("sort_key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / rows / 2))
    found = sorted(r[0] for r in keys.where(draw).select("sort_key").limit(sample).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None, sample: int = 20_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) for urls (page_id, url) under rules (host, path, verdict).

    A rule fits its host and all subdomains where the URL's path starts with the rule's path.  Of the rules that fit,
    the longest (host and path together) decides; among equals ``block`` goes before ``allow``.  Without a fitting rule
    ``rule`` is null and the verdict is ``default``.  A null url, or one without ``://``, has an empty host and path and
    fits no rule with a host.  Rules with a null field are ignored, repeated rules count once.  Repeated rows stay.

    Rows are dealt over ``parts`` sorted runs whose cuts come from a bounded sample of keys; keys end with a hash of
    page_id, so that one very common host or URL spans runs.  A rule is copied to the runs that its interval touches:
    to one run for most, and at most the nesting depth of a cut key for each cut.
    """
    small_batches(urls.sparkSession)
    n = parts or max(2, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pages = (
        urls.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("key", reversed_host(F.col("host")))
        .withColumn("sort_key", F.concat("key", F.lit(" "), F.hex(F.xxhash64("page_id", "path"))))
    )
    cuts = _cuts(pages.select("sort_key"), n, sample)
    run = lambda c: _run(c, cuts)
    spans = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").distinct()
        .withColumn("key", reversed_host(F.col("host")))
        .withColumn("run", F.explode(F.sequence(run(F.col("key")), run(F.concat("key", F.lit("\U0010ffff"))))))
    )
    both = (
        pages.select(run(F.col("sort_key")).alias("run"), "key", F.lit(1).alias("kind"), "sort_key", "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
        .unionByName(spans.select("run", "key", F.lit(0).alias("kind"), F.col("key").alias("sort_key"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict"))
    )
    return (
        both.repartitionByRange(n, "run").sortWithinPartitions("run", "sort_key", "kind")
        .mapInArrow(lambda batches: _sweep(batches, default), "page_id long, host string, path string, rule string, verdict string")
    )


def _run(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at most the key, by a binary search in an Arrow UDF."""
    if not cuts:
        return F.lit(0)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        own = np.array(keys.cast(pa.binary()).to_pylist(), dtype=object)
        return pa.array(np.searchsorted(edges, own, side="right").astype(np.int32))

    edges = np.array([c.encode() for c in cuts], dtype=object)
    return place(key)


def _sweep(batches, default: str):
    """Verdicts for rows sorted by (run, key); a rule row comes before the URLs of its interval."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
    at = None
    for batch in batches:
        out = []
        for run, key, kind, page, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("run", "key", "kind", "page_id", "host", "path", "verdict")), strict=True):
            if run != at:
                stack, at = [], run
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, own, lengths = stack[-1]
                if path not in own or verdict == "block":
                    own[path] = (host + path, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best = None
            for _, own, lengths in stack:
                for size in lengths:
                    if size <= len(path) and (found := own.get(path[:size])):
                        if best is None or (len(found[0]), found[1] == "block") > (len(best[0]), best[1] == "block"):
                            best = found
                        break
            out.append((page, host, path, best and best[0], best[1] if best else default))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), *[pa.string()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict"])
