"""Quality by nearest neighbours: labelled texts vote, weighted by their likeness in a latent space.

Texts become TF-IDF vectors of letter shapes, words and repeated word pairs; a truncated singular value decomposition of a
bounded sample of labelled rows gives the latent space.  The sample's latent vectors are broadcast; every document is
projected and compared with all of them by exact cosine products, block by block, and its nearest vote.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.batches import small_batches
from spanloom.llm import textkernel as tk
from spanloom.llm.resample import word_runs

#: Buckets of shapes and of words; two more count word pairs that the text had before, and words that stand twice in a row.
SHAPES, WORDS = 1 << 11, 1 << 11
WIDTH = SHAPES + WORDS + 2
#: Rows of a block of products: always as many, so that a row's result doesn't depend on its neighbours.
BLOCK = 128
#: Bytes of a piece of text of which shapes are counted at once.
PIECE = 1 << 20

#: Bytes as shapes see them: small letters and letters beyond ASCII, capitals, digits, blanks; others as they are.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[[*range(97, 123), *range(128, 256)]] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[[9, 11, 12, 13]] = 32


def _shapes(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Add to out (texts x WIDTH) the counts of one to three neighbouring characters' shapes."""
    shift = tk.U64(64 - (SHAPES - 1).bit_length())
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        at = a + np.flatnonzero((data[a : b + 16] & 0xC0) != 0x80)  # first bytes of characters, some of them of the next piece
        own = int(np.searchsorted(at, b))
        shape, text = _SHAPE[data[at]], np.searchsorted(offsets, at, side="right") - 1
        code = np.zeros(len(at), dtype=tk.U64)
        for n in range(1, 4):
            m = max(0, min(own, len(at) - n + 1))
            code = code[:m] * tk.U64(256) + shape[n - 1 : n - 1 + m]
            whole = text[:m] == text[n - 1 : n - 1 + m]
            bucket = (tk.mix(code + tk.U64(n << 32)) >> shift).astype(np.int64)
            found = np.bincount(text[:m][whole] * SHAPES + bucket[whole], minlength=0)
            rows = -(-len(found) // SHAPES)
            out[:rows, :SHAPES] += np.append(found, np.zeros(rows * SHAPES - len(found), found.dtype)).reshape(rows, SHAPES)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text has each feature."""
    out = np.zeros((len(offsets) - 1, WIDTH))
    _shapes(data, offsets, out)
    pairs = [np.zeros(0, np.uint64)]
    for owner, word, second, pair in word_runs(data, offsets):
        np.add.at(out, (owner, SHAPES + (word % np.uint32(WORDS)).astype(np.int64)), 1.0)
        pairs.append(second.astype(np.uint64) << np.uint64(32) | pair)
        twice = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        out[:, -2] += np.bincount(owner[1:][twice], minlength=len(out))
    key = np.sort(np.concatenate(pairs))
    again = (key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64)
    out[:, -1] = np.bincount(again, minlength=len(out))
    return out


def _counted(column: pa.Array):
    """(index of the first text, counts) for blocks of texts."""
    data, offsets, _ = tk.text_buffers(column)
    for i, j in tk.slices(offsets):
        for a in range(i, j, BLOCK):
            own = offsets[a : min(a + BLOCK, j) + 1]
            yield a, counts(data[own[0] : own[-1]], own - own[0])


@dataclass
class Neighbours:
    """Inverse document frequencies, the latent space, and the labelled vectors in it with their labels."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    share: float  # of label 1 among all labelled rows: the score of a text without features
    nearest: int = 15
    sharpness: float = 8.0

    def weighted(self, count: np.ndarray) -> np.ndarray:
        """Rows of TF-IDF, of length 1; a row without features stays 0."""
        value = np.sqrt(count) * self.idf
        return value / np.maximum(np.sqrt((value * value).sum(axis=1, keepdims=True)), 1e-12)

    def latent(self, count: np.ndarray) -> np.ndarray:
        """Rows in the latent space, of length 1."""
        z = self.weighted(count) @ self.space
        size = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return np.where(size > 1e-9, z / np.maximum(size, 1e-9), 0.0)

    def votes(self, count: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors of each row, weighted by a power of the cosine."""
        out = np.full(len(count), self.share)
        if not len(self.label):
            return out
        block = np.zeros((BLOCK, count.shape[1]))
        block[: len(count)] = count
        z = self.latent(block)
        cosine = np.maximum(z @ self.vectors.T, 0.0)
        k = min(self.nearest, len(self.label))
        least = np.partition(cosine, -k, axis=1)[:, -k]
        weight = np.where(cosine >= least[:, None], cosine, 0.0) ** self.sharpness  # vectors as near as the last are all in
        total = weight.sum(axis=1)
        found = np.divide(weight[:, self.label == 1].sum(axis=1), total, out=np.full(BLOCK, self.share), where=total > 0)
        return np.clip(np.where(z.any(axis=1), found, self.share), 0, 1)[: len(count)]  # sums in another order may pass 1


def latent_space(rows: np.ndarray, dimensions: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of rows, by subspace iteration from a fixed start."""
    q = np.random.default_rng(11).normal(size=(rows.shape[1], min(dimensions + 8, *rows.shape)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, v = np.linalg.svd(rows @ q, full_matrices=False)
    return (q @ v.T)[:, :dimensions]


def fit(docs: DataFrame, rows_per_label: int = 1_500, bytes_per_label: int = 8 << 20, dimensions: int = 48, nearest: int = 15) -> Neighbours:
    """Learn from docs (doc_id, text, quality); rows without a label 0 or 1 are left out.

    How many rows have each feature is counted over all labelled rows.  The latent space and the voters come from a sample
    of either label, picked by a hash of doc_id: about ``rows_per_label`` rows, or fewer where these would have more than
    about ``bytes_per_label`` bytes of text.  Without labelled rows every score is 0.5.
    """
    small_batches(docs.sparkSession)
    rows = docs.where("quality in (0, 1)").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    totals = {r["quality"]: r for r in rows.groupBy("quality").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()}
    if not totals:
        return Neighbours(np.zeros(WIDTH), np.zeros((WIDTH, 0)), np.zeros((0, 0)), np.zeros(0, np.int64), 0.5)
    total = sum(r["n"] for r in totals.values())
    share = totals[1]["n"] / total if 1 in totals else 0.0

    def frequencies(batches):
        n = np.zeros(WIDTH, np.int64)
        for batch in batches:
            for _, count in _counted(batch.column("text")):
                n += np.count_nonzero(count, axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["feature", "n"])

    seen = np.zeros(WIDTH)
    for r in rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        seen[r["feature"]] = r["n"]
    idf = np.log((total + 1) / (seen + 1)) + 0.1

    def sample(batches):
        for batch in batches:
            found = [row for _, count in _counted(batch.column("text")) for row in count]
            at = [np.flatnonzero(row) for row in found]
            columns = [pa.array(at, pa.list_(pa.int32())), pa.array([row[i] for row, i in zip(found, at, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("draw"), *columns], ["quality", "draw", "at", "n"])

    part = {y: min(1.0, rows_per_label / r["n"], bytes_per_label / max(1, r["bytes"])) for y, r in totals.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < F.when(F.col("quality") == 1, part.get(1, 0.0)).otherwise(part.get(0, 0.0))).select("text", "quality", draw.alias("draw"))
    picked = sorted(picked.mapInArrow(sample, "quality int, draw double, at array<int>, n array<float>").collect(), key=lambda r: (r["draw"], r["quality"], len(r["at"]), r["at"], r["n"]))
    count = np.zeros((len(picked), WIDTH), dtype=np.float32)
    for k, r in enumerate(picked):
        count[k, r["at"]] = r["n"]
    model = Neighbours(idf, np.zeros((WIDTH, 0)), np.zeros((0, 0)), np.array([r["quality"] for r in picked], dtype=np.int64), share, nearest)
    if len(picked):
        model.space = latent_space(model.weighted(count), dimensions)
        model.vectors = model.latent(count)
    return model


def score(docs: DataFrame, model: Neighbours, bound: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= ``bound``, else 0); such columns are replaced.

    Only the whole text decides.  Null texts, empty ones, and texts like none of the labelled ones get the share of label 1
    among all labelled rows.  Equal texts get equal results, whatever stands beside them.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # rows_per_label bounds it

    @F.arrow_udf(T.DoubleType())
    def voted(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *[sent.value.votes(count) for _, count in _counted(text)]]))

    found = docs.drop("score", "predicted").withColumn("score", voted(F.col("text")))
    return found.withColumn("predicted", (F.col("score") >= bound).cast("int"))
