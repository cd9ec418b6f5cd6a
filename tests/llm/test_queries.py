"""Every registered query of the training-data operators over the smallest tables: contract, SQL where there is some, accuracy."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from spanloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("select doc_id, text, lang, source from documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    rows = queries.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    found = duck.execute(queries.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in rows.collect()) == sorted(repr([r[i] for i in at]) for r in found.fetchall())


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_language_id"](spark, SF).collect()}
    assert set(got) == {d[0] for d in documents} and all(got[d[0]]["held_out"] == (crc(d[0], 3) == 1) and 0 <= got[d[0]]["score"] <= 1 for d in documents)
    late = [(got[d]["lang_pred"], lang) for d, text, lang, _ in documents if crc(d, 3) == 1 and lang and text]
    assert sum(a == b for a, b in late) >= 0.9 * len(late)


def test_op2_counts_what_is_left_after_all_batches(spark, documents):
    import re

    from spanloom.llm.tokencount import _encoding

    with open(queries.RANKS_FILE, "rb") as f:
        enc = _encoding(f.read())
    first, want = {}, Counter()
    for d, text, *_ in sorted(documents):
        first.setdefault(text or "", d)
    for d, text, lang, source in documents:
        if first[text or ""] == d:
            left = re.sub(r"(?m)^.*Licensed under [^\n]*\n?", "", text or "")
            want[source, lang, "n"] += 1
            want[source, lang, "t"] += len(enc.encode_ordinary(left))
    got = queries.QUERIES["op2_token_counts"](spark, SF).collect()
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in got} == {k[:2]: (want[(*k[:2], "n")], want[(*k[:2], "t")]) for k in want}


def test_op3(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_media_columns"](spark, SF).collect()}
    for d, text, *_ in documents:
        data = (text or "").encode()
        padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["media_sha256"] == hashlib.sha256(b"P6\n192 %d\n255\n" % (len(padded) // 576) + padded).hexdigest() and r["tile_shape"] == "16x16x3"


def test_op4(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_sharding"](spark, SF).collect()}
    total, before, slots = sum(len((t or "").encode()) + 16 for _, t, *_ in documents), 0, Counter()
    for d, text, *_ in sorted(documents):
        size = len((text or "").encode()) + 16
        shard = min(39, (2 * before + size) * 40 // (2 * total))
        r = got[d]
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) == (size, zlib.crc32((text or "").encode()), "bytes", shard, slots[shard], None)
        slots[shard] += 1
        before += size


def test_op7(spark, documents):
    by, bins, seen = {d: (s, t) for d, t, _, s in documents}, {}, Counter()
    for r in queries.QUERIES["op7_best_fit_packing"](spark, SF).collect():
        bins.setdefault((r["group"], r["bin"]), []).append((r["offset"], r["size"], r["doc_id"]))
        seen[r["doc_id"]] += r["size"]
    assert seen == Counter({d: len((t or "").encode()) for d, t, *_ in documents})
    for own in bins.values():
        own.sort()
        assert all(a[0] + a[1] <= b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= 16_384
        sources = [by[d][0] for *_, d in own if by[d][0] is not None]
        assert len(sources) == len(set(sources))


def test_op8(spark, documents):
    got = queries.QUERIES["op8_source_mixing"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in documents)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    own = Counter()
    for _, text, _, source in documents:
        own[source or ""] += len((text or "").encode()) + 16
    share = {s: math.sqrt(n) / sum(map(math.sqrt, own.values())) for s, n in own.items()}
    ends = {s: max(r["slot"] for r in got if r["source"] == s) for s in own}
    for r in got:  # before the first source ends, each is within a block of its share
        if r["slot"] <= min(ends.values()):
            assert abs(r["block"] - share[r["source"]] * r["slot"]) <= 1 + 1e-6


def test_op10(spark, duck, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_toxicity"](spark, SF).collect()}
    assert set(got) == {d[0] for d in documents} and all(r["held_out"] == (crc(d, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    by_text = {}
    for d, text, *_ in documents:
        by_text.setdefault(text or "", set()).add(got[d]["score"])
    assert all(len(s) == 1 for s in by_text.values())
    late = [(got[d]["score"], y) for d, y in duck.execute("select doc_id, toxic from labels where toxic is not null").fetchall() if crc(d, 5) == 0]
    good, bad = [s for s, y in late if y == 0], [s for s, y in late if y == 1]
    assert np.mean(good) < 0.3 and (not bad or np.mean(bad) > np.mean(good))


def test_op12(spark, duck, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_knn_quality"](spark, SF).collect()}
    assert set(got) == {d[0] for d in documents} and all(r["held_out"] == (crc(d, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    by_text = {}
    for d, text, *_ in documents:
        by_text.setdefault(text or "", set()).add(got[d]["score"])
    assert all(len(s) == 1 for s in by_text.values())
    late = [(got[d]["predicted"], y) for d, y in duck.execute("select doc_id, quality from labels where quality is not null").fetchall() if crc(d, 5) == 0]
    assert sum(a == b for a, b in late) >= 0.9 * len(late) and all(a for a, b in late if b == 1)


def test_pipeline_keeps_what_it_should(spark, documents):
    out = queries.QUERIES["pipeline"](spark, SF).collect()
    by = {d: t for d, t, *_ in documents}
    texts = Counter(by[r["doc_id"]] for r in out if r["piece"] == 0)
    assert out and max(texts.values()) == 1  # one of equal texts
    for r in out:
        assert by[r["doc_id"]] and r["size"] <= 16_384
