"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence has a logistic score from hashed words and word beginnings; the noisy-or of the sentences,
``1 - product(1 - p)``, is the document's score and is trained against the document's label, so that the labels decide
which sentences carry them.  The learned sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.batches import small_batches
from spanloom.llm import textkernel as tk

#: Lengths in bytes of the word beginnings that are features beside the word itself.
PREFIXES = (4, 5)

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True  # line feed ! . ?


@dataclass
class ToxicityModel:
    """A weight for each bucket of hashed features (0 for most) and the bias of a sentence."""

    weights: np.ndarray
    bias: float


@dataclass
class _Sentences:
    """Words and sentences of some texts: features by word, first word by sentence, first sentence by text."""

    buckets: list[np.ndarray]
    starts: np.ndarray
    sentence: np.ndarray
    first: np.ndarray


def _sentences(data: np.ndarray, offsets: np.ndarray, buckets: int) -> _Sentences:
    shift = tk.U64(64 - (buckets - 1).bit_length())
    words, starts, first, short = tk.word_hashes(data, offsets, tk.ALNUM, PREFIXES)
    cut = _ENDS[data].astype(np.int64)
    np.add.at(cut, offsets[:-1][offsets[:-1] < len(data)], 1)
    part = np.cumsum(cut)[starts] if len(starts) else starts
    heads = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else part
    return _Sentences([(h >> shift).astype(np.int64) for h in (words, *short)], starts, heads, np.searchsorted(heads, first))


def _slices(column: pa.Array, buckets: int):
    data, offsets, _ = tk.text_buffers(column)
    for i, j in tk.slices(offsets):
        own = offsets[i : j + 1]
        yield i, data[own[0] : own[-1]], own - own[0], _sentences(data[own[0] : own[-1]], own - own[0], buckets)


def _logits(found: _Sentences, model: ToxicityModel) -> np.ndarray:
    if not len(found.sentence):
        return np.zeros(0)
    value = sum(model.weights[b] for b in found.buckets)
    return np.add.reduceat(value, found.sentence) + model.bias


def _logistic(s):
    """1 / (1 + exp(-s)) without overflow."""
    return 0.5 * (1 + np.tanh(0.5 * s))


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each text's sentence values; every text is summed by itself, so its neighbours can't change its sum."""
    out = np.zeros(len(first) - 1, dtype=values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def fit_noisy_or(
    feature: np.ndarray, sentence: np.ndarray, owner: np.ndarray, silent: np.ndarray, label: np.ndarray,
    weight: np.ndarray, features: int, l2: float = 0.01, steps: int = 400, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the weighted log loss of the noisy-or, by Adam.

    feature[i] occurs in sentence[i]; sentence s belongs to document owner[s]; silent[d] counts the sentences of
    document d that have no feature at all.
    """
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    w[-1] = -6.0
    for t in range(1, steps + 1):
        _, g = noisy_or_loss(w, feature, sentence, owner, silent, label, weight, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def noisy_or_loss(
    w: np.ndarray, feature: np.ndarray, sentence: np.ndarray, owner: np.ndarray, silent: np.ndarray, label: np.ndarray, weight: np.ndarray, l2: float
) -> tuple[float, np.ndarray]:
    """(mean weighted log loss with its penalty, gradient) of the noisy-or; the last of ``w`` is the bias."""
    s = np.bincount(sentence, w[feature], minlength=len(owner)) + w[-1]
    amount = np.bincount(owner, np.logaddexp(0, s), minlength=len(label)) + silent * np.logaddexp(0, w[-1])
    held = np.clip(amount, 1e-9, 50)
    pull = weight * np.where(label == 1, -1 / np.expm1(held), 1.0)
    ds = pull[owner] * _logistic(s)
    g = np.append(np.bincount(feature, ds[sentence], minlength=len(w) - 1), ds.sum() + (pull * silent).sum() * _logistic(w[-1]))
    g[:-1] += l2 * w[:-1]
    loss = (weight * np.where(label == 1, -np.log(-np.expm1(-held)), amount)).sum() + l2 / 2 * (w[:-1] ** 2).sum()
    return loss / weight.sum(), g / weight.sum()


def fit(
    docs: DataFrame, rows_per_class: int = 4000, bytes_per_class: int = 8 << 20, buckets: int = 1 << 18, features: int = 1 << 13,
    least_z: float = 2.2,
) -> ToxicityModel:
    """Learn from docs (doc_id, text, toxic); rows without a label 0 or 1 are left out.

    How often each feature occurs in toxic and in other documents is counted over all rows; the ``features`` of the
    largest significance (a z of at least ``least_z``) are kept.  The noisy-or is trained on a sample of either label,
    picked by a hash of doc_id and weighted back to all rows: about ``rows_per_class`` rows, or fewer where these would
    have more than about ``bytes_per_class`` bytes of text. 
    """
    small_batches(docs.sparkSession)
    rows = docs.where("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def frequencies(batches):
        count, size = np.zeros((2, buckets + 1), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            label = batch.column("toxic").to_numpy()
            for i, _, offsets, found in _slices(batch.column("text"), buckets):
                word = np.searchsorted(found.starts, offsets)
                for k in range(len(offsets) - 1):
                    own = np.concatenate([b[word[k] : word[k + 1]] for b in found.buckets])
                    count[label[i + k], np.unique(own)] += 1
                    count[label[i + k], buckets] += 1
                    size[label[i + k]] += offsets[k + 1] - offsets[k]
        at = np.flatnonzero(count.any(axis=0))
        names = ["bucket", "clean", "toxic"]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *[pa.array(np.append(count[c, at], size[c])) for c in (0, 1)]], names)

    # the number of rows is bounded by the number of buckets
    seen = (
        rows.select("text", "toxic").mapInArrow(frequencies, "bucket long, clean long, toxic long")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    )
    at, q, p = (seen[c].to_numpy().astype(np.int64) for c in ("bucket", "clean", "toxic"))
    total_bytes = [int(n[at == -1].sum()) for n in (q, p)]
    at, q, p = (x[at >= 0] for x in (at, q, p))
    whole = at == buckets
    if not whole.any() or not q[whole][0] or not p[whole][0]:
        share = float(p[whole][0] > 0) if whole.any() else 0.0
        return ToxicityModel(np.zeros(buckets), 30.0 if share else -30.0)
    q_all, p_all, at, q, p = int(q[whole][0]), int(p[whole][0]), at[~whole], q[~whole], p[~whole]
    odds = np.log((p + 0.5) / (p_all - p + 0.5)) - np.log((q + 0.5) / (q_all - q + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    order = np.lexsort((at, -z))[:features]
    chosen = np.sort(at[order[z[order] >= least_z]])
    index = np.full(buckets, -1, dtype=np.int32)
    index[chosen] = np.arange(len(chosen))

    def sample(batches):
        for batch in batches:
            codes, count = [], []
            for _, _, offsets, found in _slices(batch.column("text"), buckets):
                word = np.searchsorted(found.starts, offsets)
                of = np.cumsum(np.bincount(found.sentence, minlength=len(found.starts))) - 1 if len(found.starts) else found.starts
                for k in range(len(offsets) - 1):
                    own = slice(word[k], word[k + 1])
                    f = np.concatenate([index[b[own]] for b in found.buckets])
                    s = np.concatenate([of[own] for _ in found.buckets]) - (of[own][0] if word[k] < word[k + 1] else 0)
                    codes.append(zlib.compress(np.sort(s[f >= 0] * len(chosen) + f[f >= 0]).astype(np.int64).tobytes(), 1))
                    count.append(found.first[k + 1] - found.first[k])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("draw"), pa.array(codes, type=pa.binary()), pa.array(count, type=pa.int32())], ["toxic", "draw", "codes", "count"])

    share = [min(1.0, rows_per_class / n, bytes_per_class / max(1, b)) for n, b in zip((q_all, p_all), total_bytes, strict=True)]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    picked = (
        rows.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
        .select("text", "toxic", draw.alias("draw")).mapInArrow(sample, "toxic int, draw double, codes binary, count int").toArrow()
    )
    picked = picked.sort_by([("draw", "ascending"), ("toxic", "ascending"), ("count", "ascending"), ("codes", "ascending")])  # however the rows arrive
    if not picked.num_rows:
        return ToxicityModel(np.zeros(buckets), -30.0)
    label, count = picked["toxic"].to_numpy(), picked["count"].to_numpy()
    feature, sentence, owner, silent, base = [], [], [], count.astype(np.float64), 0
    for d, item in enumerate(picked["codes"]):
        codes = np.frombuffer(zlib.decompress(item.as_buffer()), dtype=np.int64)
        own, place = np.unique(codes // max(1, len(chosen)), return_inverse=True)
        feature.append((codes % max(1, len(chosen))).astype(np.int32))
        sentence.append((place + base).astype(np.int32))
        owner.append(np.full(len(own), d, dtype=np.int32))
        silent[d] -= len(own)
        base += len(own)
    weight = np.where(label == 1, 1 / share[1], 1 / share[0])
    w, bias = fit_noisy_or(np.concatenate(feature), np.concatenate(sentence), np.concatenate(owner), silent, label, weight, len(chosen))
    weights = np.zeros(buckets)
    weights[chosen] = w
    return ToxicityModel(weights, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score, predicted, n_offending and worst (the most offending sentence); such columns are replaced.

    score is the noisy-or of all sentences of the whole text; predicted is 1 from 0.5 on; n_offending counts the
    sentences that alone reach 0.5.  Null or empty texts and texts without words have no sentence: score 0.0 and a null
    ``worst``.  Only the text decides: equal texts get equal results.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted", "n_offending", "worst")
    width = len(model.weights)
    fields = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_offending", T.IntegerType()), ("worst", T.StringType())]

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in fields]))
    def toxic(text: pa.Array) -> pa.Array:
        total, n, worst = [np.zeros(0)], [np.zeros(0, np.int32)], []
        for _, data, offsets, found in _slices(text, width):
            s = _logits(found, model)
            total.append(-np.expm1(-_by_text(np.logaddexp(0, s), found.first)))
            n.append(_by_text(s >= 0, found.first).astype(np.int32))
            for k in range(len(offsets) - 1):
                a, b = found.first[k], found.first[k + 1]
                worst.append(_sentence(data, offsets, found, k, a + int(s[a:b].argmax())) if b > a else None)
        score = np.clip(np.concatenate(total), 0, 1)
        columns = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.concatenate(n)), pa.array(worst, type=pa.string())]
        return pa.StructArray.from_arrays(columns, [f for f, _ in fields])

    found = toxic(F.col("text"))
    return kept.select("*", *[found[f].alias(f) for f, _ in fields])


def _span(data: np.ndarray, offsets: np.ndarray, found: _Sentences, k: int, s: int) -> tuple[int, int]:
    """Bytes from the first word of sentence s of text k to the character that ends it."""
    start = int(found.starts[found.sentence[s]])
    last = s + 1 < len(found.sentence) and s + 1 < found.first[k + 1]
    end = int(found.starts[found.sentence[s + 1]]) if last else int(offsets[k + 1])
    stop = np.flatnonzero(_ENDS[data[start:end]])
    return start, start + int(stop[0]) + 1 if len(stop) else end


def _sentence(data: np.ndarray, offsets: np.ndarray, found: _Sentences, k: int, s: int) -> str:
    start, end = _span(data, offsets, found, k, s)
    return data[start:end].tobytes().decode("utf-8", "replace").strip()


def locate(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score): every sentence whose own score is at least ``least``.

    start and end are character offsets into the text.  ``least`` may be any number: all sentences have a score of at
    least 0.  Documents without such a sentence, null and empty texts have no row; a row with a null doc_id keeps it, and
    repeated rows give their sentences each.  Other columns are ignored.
    """
    width = len(model.weights)

    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for i, data, offsets, found in _slices(batch.column("text"), width):
                own = _logistic(_logits(found, model))
                for x in np.flatnonzero(own >= least).tolist():
                    k = int(np.searchsorted(found.first, x, side="right")) - 1
                    a, b = _span(data, offsets, found, k, x)
                    lead = len(data[offsets[k] : a].tobytes().decode("utf-8", "replace"))
                    text = data[a:b].tobytes().decode("utf-8", "replace")
                    out.append((ids[i + k], lead, lead + len(text), text, float(own[x])))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, start long, end long, sentence string, score double")
