"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by follow-the-regularised-leader with elastic-net penalties, so that most of them are exactly
zero; a temperature fitted on rows kept out of the training calibrates the probabilities.  Document frequencies cover
all training rows; the regression itself is fitted on a sample of at most about ``rows_per_class`` rows of each
language.  Scoring runs over whole texts in Arrow batches with one pass of numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.batches import small_batches
from spanloom.llm import textkernel as tk

UNKNOWN = "und"
_ODD = tk.mix(np.arange(1, 5, dtype=tk.U64)) | tk.U64(1)

#: Bytes as n-grams see them: letters of ASCII folded, all its other bytes one separator; other bytes as they are.
_SEEN = tk.FOLD.copy()
_SEEN[[b for b in range(128) if not chr(b).isalpha()]] = 32
_SEEN[65:91] = np.arange(97, 123)


@dataclass
class LanguageModel:
    """Learned languages, inverse document frequencies, sparse weights and temperature."""

    buckets: int
    orders: tuple[int, ...]
    classes: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    rows: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def scores(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Uncalibrated scores of the classes; ``rows`` tells the row of ``weights`` that a bucket has (0: a row of zeros)."""
        return value @ self.weights[self.rows[at]] + self.bias


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one number per character, index of each text's first one), case folded for ASCII and Latin-1."""
    seen = _SEEN[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    seen[upper] += 32
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    length = np.diff(np.append(lead, len(data)))
    char = seen[lead].astype(tk.U64)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        char[more] = (char[more] << tk.U64(8)) | seen[lead[more] + k]
    return char, np.searchsorted(lead, offsets)


def features(
    data: np.ndarray, offsets: np.ndarray, buckets: int, orders: tuple[int, ...]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text (hashed n-grams, their counts).  N-grams with two separators in a row are left out."""
    char, first = _characters(data, offsets)
    blank = char == 32
    shift = tk.U64(64 - (buckets - 1).bit_length())
    hashed, usable = [], []
    for n in orders:
        m = max(0, len(char) - n + 1)
        h, ok = np.full(m, tk.U64(n), dtype=tk.U64), np.ones(m, dtype=bool)
        for i in range(n):
            h += char[i : i + m] * _ODD[i]
            ok &= ~(blank[i : i + m] & blank[i - 1 : i - 1 + m]) if i else True
        if n == 1:
            ok &= ~blank[:m]
        hashed.append((tk.mix(h) >> shift).astype(np.int32))
        usable.append(ok)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = [h[s : max(s, e - n + 1)][ok[s : max(s, e - n + 1)]] for h, ok, n in zip(hashed, usable, orders, strict=True)]
        own = np.concatenate(own)
        if len(own) < buckets // 64:
            yield np.unique(own, return_counts=True)
        else:
            count = np.bincount(own, minlength=buckets)
            at = np.flatnonzero(count)
            yield at, count[at]


def _all_features(column: pa.Array, buckets: int, orders: tuple[int, ...]):
    data, offsets, _ = tk.text_buffers(column)
    for i, j in tk.slices(offsets):
        own = offsets[i : j + 1]
        yield from features(data[own[0] : own[-1]], own - own[0], buckets, orders)


def _lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets, _ = tk.text_buffers(column)
    ascii_letter = np.concatenate([[0], np.cumsum((_SEEN[data] != 32) & (data < 128))])[offsets]
    out = np.diff(ascii_letter) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts)) == part


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, buckets: int,
    l1: float, l2: float, alpha: float = 0.5, beta: float = 1.0, epochs: int = 4,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial regression by FTRL-proximal; rows are (indices, values)."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        penalty = np.where(np.asarray(at)[:, None] == buckets, 0.0, l1)  # the bias is not penalised
        return np.where(np.abs(zz) <= penalty, 0.0, -(zz - np.sign(zz) * penalty) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, value = np.append(rows[i][0], buckets), np.append(rows[i][1], 1.0)
            w = weights(at)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label[i]] -= 1
            g = value[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(buckets + 1))
    return w[:buckets], w[buckets]


def fit_temperature(score: np.ndarray, label: np.ndarray) -> float:
    """The temperature that minimises the log loss of the scores, by golden-section search on its logarithm."""
    if not len(label):
        return 1.0

    def loss(t):
        s = score / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return -(s[np.arange(len(label)), label] - np.log(np.exp(s).sum(axis=1))).mean()

    low, high, ratio = np.log(0.5), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    docs: DataFrame, rows_per_class: int = 1000, buckets: int = 1 << 16, orders: tuple[int, ...] = (1, 2, 3),
    l1: float = 0.02, l2: float = 0.1, calibration: float = 0.2, sample_bytes: int = 256 << 20, cells: int = 1 << 24,
) -> LanguageModel:
    """Learn from docs (doc_id, text, lang), all of whose rows with a language and a letter are training rows.

    Class counts and document frequencies cover every row.  The regression and the temperature see about
    ``rows_per_class`` rows of a language (all, if it has fewer), picked by a hash of doc_id, or fewer where all these
    would have more than about ``sample_bytes`` bytes of text, of which every language has an equal share; a share
    ``calibration`` of them only calibrates.  Of the sample's n-grams those in most rows are used, so many that they make
    at most ``cells`` weights.  All languages are learned; their number reaches the driver.
    """
    small_batches(docs.sparkSession)
    model = LanguageModel(buckets, orders)
    rows = docs.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "text", "lang")

    def frequencies(batches):
        seen, df = 0, np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            seen += batch.num_rows
            for at, _ in _all_features(batch.column("text"), buckets, orders):
                df[at] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], seen))], ["bucket", "df"]
        )

    totals = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    counts = {c: r["n"] for c, r in totals.items()}
    model.classes = sorted(counts)
    if not counts:
        return model
    df = rows.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = dict(zip(df["bucket"].to_pylist(), df["df"].to_pylist(), strict=True))
    total = df.pop(-1, 0)
    model.idf = np.full(buckets, np.log(1.0 + total) + 1)
    model.idf[list(df)] = np.log((1.0 + total) / (1.0 + np.array(list(df.values())))) + 1

    part = [(c, min(1.0, rows_per_class / r["n"], sample_bytes / len(totals) / max(1, r["bytes"]))) for c, r in totals.items()]
    share = F.broadcast(docs.sparkSession.createDataFrame(part, "lang string, share double"))  # a row per language
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)

    def sample(batches):
        for batch in batches:
            found = list(_all_features(batch.column("text"), buckets, orders))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("late"), batch.column("draw"), *[pa.array([f[k].astype(np.int32) for f in found], type=pa.list_(pa.int32())) for k in (0, 1)]],
                ["lang", "late", "draw", "at", "tf"],
            )

    picked = (
        rows.join(share, "lang").where(draw < F.col("share"))
        .select("text", "lang", draw.alias("draw"), (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1000)) < calibration * 1000).alias("late"))
        .mapInArrow(sample, "lang string, late boolean, draw double, at array<int>, tf array<int>")
        .toArrow()
    )
    place = {c: k for k, c in enumerate(model.classes)}
    label = np.array([place[x] for x in picked["lang"].to_pylist()], dtype=np.int64)
    late = np.array(picked["late"].to_pylist(), dtype=bool)
    at, tf = ([x.values.to_numpy() for x in picked[c]] for c in ("at", "tf"))
    vectors = [(a, _weighted(t, model.idf[a])) for a, t in zip(at, tf, strict=True)]
    order = np.lexsort((picked["draw"].to_numpy(), [int(a.sum()) for a in at], [len(a) for a in at], label))  # however the rows arrive
    train = [i for i in order.tolist() if not late[i]]
    found = np.bincount(np.concatenate([vectors[i][0] for i in train]), minlength=buckets) if train else np.zeros(buckets, np.int64)
    used = np.sort(np.argsort(-found, kind="stable")[: min(int((found > 0).sum()), max(1, cells // len(counts)))])  # all others stay 0
    own = [(np.searchsorted(used, vectors[i][0]), vectors[i]) for i in train]
    own = [(k[ok], v[ok]) for k, (a, v) in own for ok in [used[np.minimum(k, len(used) - 1)] == a]]
    weights, model.bias = fit_ftrl(own, label[train], len(counts), len(used), l1, l2)
    live = np.flatnonzero(weights.any(axis=1))
    model.rows = np.zeros(buckets, dtype=np.int32)
    model.rows[used[live]] = np.arange(1, len(live) + 1)
    model.weights = np.concatenate([np.zeros((1, len(counts))), weights[live]])
    if late.any():
        scores = np.array([model.scores(*v) for v, k in zip(vectors, late, strict=True) if k])
        model.temperature = fit_temperature(scores, label[late])
    return model


def _weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = tf * idf
    return value / max(1e-12, np.sqrt(value @ value))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score (the calibrated probability of lang_pred); columns of these names are replaced.

    Every whole text is scored from its characters alone.  A null text, a text without a letter of any script, and any
    text if the model has learned no language give ``und`` and 0.0.  Rows are kept one for one, an empty table stays
    empty, and equal texts get equal results.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    names = np.array([*model.classes, UNKNOWN])

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def language(text: pa.Array) -> pa.Array:
        best, score = np.full(len(text), len(names) - 1), np.zeros(len(text))
        if model.weights is not None:
            able = _lettered(text)
            for i, (at, tf) in enumerate(_all_features(text, model.buckets, model.orders)):
                if able[i]:
                    s = model.scores(at, _weighted(tf, model.idf[at])) / model.temperature
                    best[i] = s.argmax()
                    score[i] = 1 / np.exp(s - s[best[i]]).sum()
        return pa.StructArray.from_arrays([pa.array(names[best]), pa.array(score)], ["lang_pred", "score"])

    found = language(F.col("text"))
    return kept.select("*", found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))
