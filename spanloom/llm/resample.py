"""Importance resampling towards a target: rows drawn without replacement by their likeness to another set of texts.

Hashed word runs are counted over all documents and all target texts; a bucket's gain is the logarithm of its shares in
both.  Every document's weight is the mean gain of its features, scored in arrays; weight plus a keyed Gumbel noise orders
the draw.  Each partition sorts its eligible rows as one run and cuts the run into pages at the bounds of score ranges;
a task merges the pages of one range by a tournament tree, opening a page when the merge reaches its first row, and ranks
end at the exact number to draw.  Rows below the last range never leave their runs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.batches import small_batches
from spanloom.functions.durable import durable
from spanloom.llm import textkernel as tk

BUCKETS = 10_000
#: Words of a chunk, and length from which a word's checksum is left to zlib.
CHUNK, LONG = 1 << 17, 48
#: Rows of a merge range at least, ranges at most, and rows of a page.
RANGE_ROWS, RANGES, PAGE = 1 << 14, 1 << 13, 4_096

_FULL, _BLANK = np.uint32(0xFFFFFFFF), np.uint8(0x20)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _advance(data: np.ndarray, starts: np.ndarray, length: np.ndarray, order: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Checksum registers after the words' bytes, all words byte by byte together; ``order`` has the longest words first."""
    at, left, now = starts[order], length[order], state[order]
    for k in range(min(int(left[0]), LONG) if len(left) else 0):
        n = len(left) - int(np.searchsorted(left[::-1], k, side="right"))
        now[:n] = _step(now[:n], tk.FOLD[data[at[:n] + k]])
    for i in range(int((left > LONG).sum())):
        rest = tk.FOLD[data[at[i] + LONG : at[i] + left[i]]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i] ^ _FULL)) ^ int(_FULL)
    out = np.empty_like(now)
    out[order] = now
    return out


def word_runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, crc32 of each word, text, crc32 of each two neighbouring words), a chunk of words at a time.

    A word is a run of digits, lower-cased letters a to z and bytes of other characters.  Checksums are of
    the words' UTF-8 bytes, joined by a space.  Memory is a few bytes for each byte of the batch, however long one text or
    one word is.
    """
    inside = tk.ALNUM[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    del start
    stops = np.flatnonzero(~inside)
    ends = np.minimum(np.append(stops, len(data))[np.searchsorted(stops, starts)], offsets[np.searchsorted(offsets, starts, side="right")])
    length = ends - starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    last: np.ndarray | None = None  # register after the last word of the chunk before, and its text
    before = -1
    for a in range(0, len(starts), CHUNK):
        own = slice(a, a + CHUNK)
        s, n, text = starts[own], length[own], owner[own]
        order = np.argsort(-n, kind="stable")
        single = _advance(data, s, n, order, np.full(len(s), _FULL, np.uint32))
        led = np.append(single[:1] if last is None else last, single[:-1])
        pair = _advance(data, s, n, order, _step(led, _BLANK))
        joined = np.append(before, text[:-1]) == text
        yield text, single ^ _FULL, text[joined], pair[joined] ^ _FULL
        last, before = single[-1:], int(text[-1])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts (a column ``text``); at most ``buckets`` rows reach the driver."""
    small_batches(texts.sparkSession)

    def count(batches):
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            data, offsets, _ = tk.text_buffers(batch.column("text"))
            for i, j in tk.slices(offsets):
                own = offsets[i : j + 1]
                for _, word, _, pair in word_runs(data[own[0] : own[-1]], own - own[0]):
                    n += np.bincount(np.append(word, pair) % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the source), for every bucket."""
    n, t_all, s_all = len(target), int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, n_words, weight): the floored mean gain of each text's features, 0 for a text without words."""
    small_batches(docs.sparkSession)
    fields = ["n_features", "n_words", "weight"]

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in fields]))
    def scored(text: pa.Array) -> pa.Array:
        data, offsets, _ = tk.text_buffers(text)
        n, total = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for i, j in tk.slices(offsets):
            own = offsets[i : j + 1]
            for text_of_word, word, text_of_pair, pair in word_runs(data[own[0] : own[-1]], own - own[0]):
                owner = np.append(text_of_word, text_of_pair)
                n[i:j] += np.bincount(owner, minlength=j - i)
                np.add.at(total, owner + i, gain[np.append(word, pair) % np.uint32(len(gain))])
        return pa.StructArray.from_arrays([pa.array(n), pa.array((n + 1) // 2), pa.array(total // np.maximum(n, 1))], fields)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(F.col("text")).alias("_s"))
    return found.select("doc_id", *[f"_s.{c}" for c in fields])


class Tournament:
    """Sorted pages merged by a winner tree: each inner node holds the slot whose head is the smaller of its two sides."""

    def __init__(self) -> None:
        self.pages: list[list | None] = [None]
        self.at = [0]
        self.free = [0]
        self.tree = [0, 0]

    def _less(self, a: int, b: int) -> int:
        x, y = self.pages[a], self.pages[b]
        if x is None or y is None:
            return b if x is None else a
        return a if x[self.at[a]][0] <= y[self.at[b]][0] else b

    def _replay(self, slot: int) -> None:
        size, node = len(self.pages), (slot + len(self.pages)) // 2
        while node:
            sides = [c - size if c >= size else self.tree[c] for c in (2 * node, 2 * node + 1)]
            self.tree[node] = self._less(*sides)
            node //= 2

    def _grow(self) -> None:
        size = len(self.pages)
        self.pages += [None] * size
        self.at += [0] * size
        self.free += range(size, 2 * size)
        self.tree = [0] * (2 * size)
        for slot in range(0, 2 * size, 2):
            self._replay(slot)

    def add(self, page: list) -> None:
        """A page: a list of (key, row) in the order of keys."""
        if not self.free:
            self._grow()
        slot = self.free.pop()
        self.pages[slot], self.at[slot] = page, 0
        self._replay(slot)

    def head(self):
        """The smallest key, or None."""
        slot = self.tree[1] if len(self.pages) > 1 else 0
        page = self.pages[slot]
        return None if page is None else page[self.at[slot]][0]

    def pop(self):
        """The row with the smallest key."""
        slot = self.tree[1] if len(self.pages) > 1 else 0
        row = self.pages[slot][self.at[slot]][1]
        self.at[slot] += 1
        if self.at[slot] == len(self.pages[slot]):
            self.pages[slot] = None
            self.free.append(slot)
        self._replay(slot)
        return row

    def rest(self) -> list[list]:
        """What is left of the open pages."""
        return [page[at:] for page, at in zip(self.pages, self.at, strict=True) if page is not None]


def merged(pages: Iterable[list], most: int) -> Iterator:
    """The rows of all pages, the first ``most`` in order and the others as they lie.

    Pages come in the order of their first keys, and a page is opened when the merge reaches it.
    """
    tree, pages = Tournament(), iter(pages)
    page = next(pages, None)
    while most > 0:
        head = tree.head()
        if page is not None and (head is None or page[0][0] <= head):
            tree.add(page)
            page = next(pages, None)
        elif head is None:
            return
        else:
            yield tree.pop()
            most -= 1
    for left in chain(tree.rest(), [page or []], pages):
        yield from (row for _, row in left)


_ROW = ["doc_id", "n_features", "weight", "score"]
_LAST_ID = (1 << 63) - 1  # null ids stand after all others


def _bounds(scored: DataFrame, draw: int, counts: list[tuple[int, int]], rows: int) -> list[tuple[int, int]]:
    """Last keys (-score, doc_id) of the ranges, in order, up to the one that completes the draw.

    counts: (score, rows) from the highest score on.  A score with more rows than a range is cut at percentiles of doc_id.
    """
    out, own, done, heavy = [], 0, 0, []
    for score, n in counts:
        if n > rows:
            heavy.append((score, n))
        own, done = own + n, done + n
        if own >= rows or done >= draw:
            out.append((-score, _LAST_ID))
            own = 0
        if done >= draw:
            break
    for score, n in heavy:  # each holds a range's rows, so these are fewer than the ranges
        share = [k * rows / n for k in range(1, math.ceil(n / rows))]
        cuts = scored.where(F.col("score") == score).agg(F.percentile_approx("doc_id", share, 1_000)).first()[0]
        out += [(-score, x) for x in cuts or []]
    return sorted(set(out))


def draw(scored: DataFrame, count: int, range_rows: int = RANGE_ROWS, ranges: int = RANGES, page: int = PAGE) -> DataFrame:
    """scored (doc_id, n_features, weight, score, eligible) with rank (1, 2, ...) for the ``count`` best eligible rows, else null.

    The best have the highest score; ties go to the smaller doc_id, null last, and rows with equal ones are taken in an
    arbitrary order.  ``scored`` must be a written table: it is read three times.  The number of different scores reaches
    the driver: weights and noise are thousandths of logarithms, so that these are fewer than 200,000.
    """
    none = F.lit(None).cast("long").alias("rank")
    counts = sorted(((r["score"], r["n"]) for r in scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    count = min(count, sum(n for _, n in counts))
    if count <= 0:
        return scored.select(*_ROW, none)
    bounds = _bounds(scored, count, counts, max(range_rows, count // ranges))
    least = -bounds[-1][0]
    ends = np.array([(s, i) for s, i in bounds], dtype=np.int64)

    def run(batches):
        """Pages of one sorted run: no page crosses a range."""
        for batch in batches:
            score, doc = batch.column("score").to_numpy(), batch.column("doc_id").fill_null(_LAST_ID).to_numpy()
            lo, hi = np.searchsorted(ends[:, 0], -score, side="left"), np.searchsorted(ends[:, 0], -score, side="right")
            at = np.array([a if b - a < 2 else a + np.searchsorted(ends[a:b, 1], d) for a, b, d in zip(lo, hi, doc, strict=True)], dtype=np.int64)
            cut = np.unique(np.append(np.flatnonzero(np.diff(at, prepend=-1)), np.arange(0, len(at), page)))
            stop = np.append(cut[1:], len(at))
            offsets = pa.array(np.append(cut, len(at)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c).cast(pa.int64())) for c in _ROW]
            heads = [pa.array(at[cut]), pa.array(-score[cut]), pa.array(doc[cut]), pa.array(stop - cut)]
            yield pa.RecordBatch.from_arrays([*heads, *lists], ["range", "s", "d", "n", *_ROW])

    eligible = scored.where("eligible").where(F.col("score") >= least).select(*_ROW)
    runs = eligible.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"))
    lists = ", ".join(f"{c} array<long>" for c in _ROW)
    pages = durable(runs.mapInArrow(run, f"range long, s long, d long, n long, {lists}"), "pages")
    sizes, first, before = {r["range"]: r["n"] for r in pages.groupBy("range").agg(F.sum("n").alias("n")).collect()}, {}, 0
    for k in sorted(sizes):
        first[k], before = before, before + sizes[k]

    def opened(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield r["range"], [((-s, _LAST_ID if d is None else d), (d, n, w, s)) for d, n, w, s in zip(*[r[c] for c in _ROW], strict=True)]

    def merge(batches):
        now, rank, out = None, 0, []

        def told():
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*_ROW, "rank"])

        source = opened(batches)
        held = next(source, None)

        def of(k):
            nonlocal held
            while held is not None and held[0] == k:
                yield held[1]
                held = next(source, None)

        while held is not None:
            now = held[0]
            rank = first[now]
            for row in merged(of(now), count - rank):
                rank += 1
                out.append((*row, rank if rank <= count else None))
                if len(out) >= 10_000:
                    yield told()
                    out = []
        yield told()

    dealt = pages.repartition(F.col("range")).sortWithinPartitions("range", "s", "d").drop("s", "d", "n")
    drawn = dealt.mapInArrow(merge, ", ".join(f"{c} long" for c in (*_ROW, "rank")))
    rest = scored.where(~F.col("eligible") | (F.col("score") < least))
    return drawn.unionByName(rest.select(*_ROW, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, **sizes: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document (doc_id, text), given target texts (text).

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down.  score is the weight plus
    floor(-1000 * ln(-ln(u))), u from sha256 of seed and doc_id.  Null and empty texts have no features, weight 0, and are
    never drawn; a null doc_id is hashed as an empty one and comes last among ties; repeated rows count and are drawn each
    for itself.  Other columns are ignored.  An empty table, or none with enough words, has no ranks.
    """
    gain = gains(bucket_counts(target, buckets), bucket_counts(docs, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(u))).cast("long")
    scored = weigh(docs, gain).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    scored = durable(scored, "scored")
    return draw(scored, percent * scored.where("eligible").count() // 100, **sizes)
