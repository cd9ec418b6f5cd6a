"""Every operator and stage on small tables: awkward rows, empty tables, and brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import embed_dedup, langid, media, mixing, packing, sharding, stages, tokencount, toxicity, urlfilter
from spanloom.llm.components import components
from spanloom.llm import ngram_join
from spanloom.llm.ngram_join import Bands, block_digests, multiply, ngram_components, sketch, within_reach
from spanloom.llm.queries import RANKS_FILE

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, root long, bin string"
GERMAN = "der hund und die katze sind nicht im haus weil sie draußen spielen. "
ENGLISH = "the dog and the cat are not in the house because they play outside. "
SPANISH = "el perro y el gato no están en la casa porque juegan afuera. "


def rows():
    """Nulls in every column, empty, blank, letterless and very long texts, ties, repeated rows, clashing columns."""
    out = []
    for i in range(60):
        text, lang = [(GERMAN, "de"), (ENGLISH, "en"), (SPANISH, "es")][i % 3]
        out.append((i, f"{text}{text[::-1][: i + 3]} Nummer{i}.", lang, f"s{i % 4}", len(text), 1.0, 3, 1, "x"))
    out += [(60, None, "en", "s0", None, None, None, None, None), (61, "", None, None, 0, 0.0, 0, 0, ""), (62, " \t\n", "de", "s1", 3, 1.0, 1, 1, "y")]
    out += [(63, "1234 — 56!", "es", "s2", 10, 1.0, 1, 1, "z"), (None, ENGLISH, "en", None, 1, 1.0, 1, 1, "n"), (64, ENGLISH * 4000, "en", "s0", 1, 1.0, 1, 1, "long")]
    out += [(65, ENGLISH, None, "s3", 1, 1.0, 1, 1, "a"), (66, ENGLISH, None, "s3", 1, 1.0, 1, 1, "a"), (66, ENGLISH, None, "s3", 1, 1.0, 1, 1, "a")]
    out += [(67, "ab", "en", "s1", 2, 1.0, 1, 1, "s"), (68, "AB", "en", "s1", 2, 1.0, 1, 1, "s"), (69, "日本語 текст", "ja", "s1", 2, 1.0, 1, 1, "s")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (61, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_language(docs, empty):
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    assert (model.rows > 0).mean() < 0.1 and (model.weights[1:] == 0).any()
    out = langid.predict(docs, model)
    assert out.count() == len(rows()) and out.columns.count("score") == 1
    got = by_id(out, "lang_pred", "score")
    for i in range(60):
        assert got[i][0] == ("de", "en", "es")[i % 3] and 0 <= got[i][1] <= 1
    assert all(got[i] == ("und", 0.0) for i in (60, 61, 62, 63)) and got[64][0] == "en"
    assert got[65] == got[66]
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_language_scores_equal_a_plain_sum(spark, docs):
    model = langid.fit(docs.where("doc_id % 2 = 0 and lang in ('de', 'en')"))
    assert len(model.classes) == 2
    got = by_id(langid.predict(docs, model), "lang_pred", "score")
    for d, text, *_ in rows()[:60]:
        low = text.lower().encode()
        raw = np.frombuffer(low, np.uint8)
        counts = dict(zip(*[x.tolist() for x in next(langid.features(raw, np.array([0, len(raw)]), model.buckets, model.orders))], strict=True))
        value = {k: n * model.idf[k] for k, n in counts.items()}
        length = math.sqrt(sum(v * v for v in value.values()))
        raw_scores = [float(model.bias[c] + sum(v / length * model.weights[model.rows[k]][c] for k, v in value.items())) / model.temperature for c in range(2)]
        p = [math.exp(x) / sum(math.exp(y) for y in raw_scores) for x in raw_scores]
        assert got[d][0] == model.classes[p.index(max(p))] and abs(got[d][1] - max(p)) < 1e-9


def test_temperature_flattens_overconfident_scores():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 3, 500)
    score = rng.normal(0, 1, (500, 3))
    score[np.arange(500), label] += 1
    assert langid.fit_temperature(score * 8, label) > 4


def test_toxicity_learns_sentences(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]

    def text(bad):
        parts = [" ".join(rng.choices(words, k=8)) for _ in range(6)]
        if bad:
            parts[rng.randrange(6)] += " " + rng.choice(["vilescum", "vilerat"])
        return ". ".join(parts) + "."

    data = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 300"))
    late = toxicity.score(df.where("doc_id >= 300"), model).collect()
    assert sum(r["predicted"] == r["toxic"] for r in late) >= 97
    assert all("vile" in r["worst"] for r in late if r["toxic"])
    found = toxicity.locate(df, model).collect()
    texts = dict((i, t) for i, t, _ in data)
    assert found and all("vile" in r["sentence"] and texts[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] for r in found)


def test_toxicity_edges(docs, empty, labels, spark):
    marks = spark.read.parquet(f"{labels}/labels.parquet")
    model = toxicity.fit(stages.labelled(docs, marks))
    out = toxicity.score(docs, model)
    got = by_id(out, "score", "predicted", "worst")
    assert out.count() == len(rows()) and got[60] == got[61] == got[62] == (0.0, 0, None)
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    none = toxicity.fit(stages.labelled(empty, marks))
    assert toxicity.score(empty, none).count() == 0 and toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.locate(docs, none).count() == 0


def test_equal_texts_score_equal_among_any_neighbours(spark):
    rng = np.random.default_rng(6)
    model = toxicity.ToxicityModel(rng.normal(0, 0.7, 1 << 12), -2.0)
    same = "Some words here. Others there! And a last one"
    data = [(i, same if i % 9 == 4 else " ".join(f"w{x}" + "." * int(x % 7 == 0) for x in rng.integers(0, 900, int(rng.integers(0, 400))))) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = by_id(toxicity.score(df, model), "score", "n_offending", "worst")
    assert len({got[i] for i in range(900) if i % 9 == 4}) == 1
    plain = toxicity._sentences
    for i, text in data[:60]:  # the noisy-or sentence by sentence
        raw = np.frombuffer(text.encode(), np.uint8)
        found = plain(raw, np.array([0, len(raw)]), 1 << 12)
        edges = [*found.sentence.tolist(), len(found.starts)]
        keep = 1.0
        for a, b in zip(edges, edges[1:], strict=False):
            keep *= 1 - 1 / (1 + math.exp(-(sum(float(model.weights[bucket[k]]) for bucket in found.buckets for k in range(a, b)) + model.bias)))
        assert abs(got[i][0] - (1 - keep)) < 1e-9
    marks = toxicity.locate(df, model, 0.0).groupBy("doc_id").count().collect()
    assert len(marks) == sum(bool(t) for _, t in data) and toxicity.locate(df, model, 1.5).count() == 0


def test_noisy_or_gradient_equals_differences():
    rng = np.random.default_rng(9)
    feature, sentence, owner = rng.integers(0, 6, 40), np.sort(rng.integers(0, 12, 40)), np.sort(rng.integers(0, 5, 12))
    args = (feature, sentence, owner, np.array([0.0, 1, 0, 2, 0]), np.array([1, 0, 1, 0, 1]), np.array([1.0, 2, 1, 3, 1]), 0.01)
    w = rng.normal(0, 0.5, 7)
    _, g = toxicity.noisy_or_loss(w, *args)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert abs((toxicity.noisy_or_loss(w + step, *args)[0] - toxicity.noisy_or_loss(w - step, *args)[0]) / 2e-6 - g[k]) < 1e-6


def test_media_round_trip(docs, empty):
    got = by_id(media.media_digests(media.text_media(docs)), "n_bytes", "payload_sha256", "tail_crc32")
    for r in rows():
        data = (r[1] or "").encode()
        padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert got[r[0]] == (len(data), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert media.media_digests(media.text_media(empty)).count() == 0


def bmp(pixels, bits, palette=None, top_down=False):
    """Height x width x 3 pixels, or height x width palette numbers, as an uncompressed BMP."""
    height, width = pixels.shape[:2]
    stride = (width * bits + 31) // 32 * 4
    lines = []
    for row in pixels if top_down else pixels[::-1]:
        if bits >= 24:
            line = b"".join(bytes(p[::-1].tolist()) + bytes(bits == 32) for p in row)
        else:
            line = np.packbits(((row[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes()
        lines.append(line.ljust(stride, b"\0"))
    table = b"".join(bytes([b, g, r, 0]) for r, g, b in palette or [])
    start = 54 + len(table)
    info = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + (-height if top_down else height).to_bytes(4, "little", signed=True)
    info += b"\1\0" + bits.to_bytes(2, "little") + bytes(16) + len(palette or []).to_bytes(4, "little") + bytes(4)
    return b"BM" + (start + stride * height).to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little") + info + table + b"".join(lines)


@pytest.mark.parametrize("top_down", [False, True])
@pytest.mark.parametrize("bits", [1, 4, 8, 24, 32])
def test_bmp_of_all_depths(bits, top_down):
    rng = np.random.default_rng(bits)
    if bits >= 24:
        want = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
        data = bmp(want, bits, top_down=top_down)
    else:
        palette = [tuple(rng.integers(0, 256, 3).tolist()) for _ in range(min(1 << bits, 20))]
        index = rng.integers(0, len(palette), (5, 7))
        want = np.array(palette, dtype=np.uint8)[index]
        data = bmp(index, bits, palette, top_down)
    assert (media.decode(data) == want).all()
    for cut in range(0, len(data), 3):  # no cut file is more than a bad image
        try:
            media.decode(data[:cut])
        except media.BadImage:
            continue


def test_netpbm_of_all_kinds_and_malformed_bytes(spark):
    deep = np.random.default_rng(3).integers(0, 65536, (4, 3, 3)).astype(np.uint16)
    assert (media.decode(b"P6 3 4 65535\n" + deep.astype(">u2").tobytes()) == deep).all()
    assert media.decode(b"P3 1 2 255 1 2 3 4 5 6").ravel().tolist() == [1, 2, 3, 4, 5, 6]
    assert media.decode(b"P2 3 1 15\n0 7 15").ravel().tolist() == [0, 119, 255]
    assert media.decode(b"P5 2 1 300\n" + np.array([0, 300], ">u2").tobytes()).ravel().tolist() == [0, 65535]
    bad = [b"P2 2 1 255\n1 word", b"P4 9 9\n", b"P4", b"P2 2 1 9\n1 300", b"P5 1 1 " + b"9" * 5000, b"P6 999999999 999999999 255\n", b"", b"P", b"BM" + bytes(60), bmp(np.zeros((1, 1), int), 8, [(0, 0, 0)])[:56]]
    bad.append(bmp(np.zeros((1, 1), int), 8, [(0, 0, 0)])[:46] + (999).to_bytes(4, "little") + bytes(20))
    for data in bad:
        with pytest.raises(media.BadImage):
            media.decode(data)
    rng = np.random.default_rng(4)
    for _ in range(300):  # random damage
        data = bytearray(bmp(rng.integers(0, 16, (3, 5)), 4, [(i, i, i) for i in range(16)]))
        for _ in range(4):
            data[rng.integers(2, len(data))] = rng.integers(0, 256)
        try:
            media.decode(bytes(data))
        except media.BadImage:
            continue
    table = spark.createDataFrame([(i, bytearray(x), "x") for i, x in enumerate(bad)] + [(None, None, "x")], "media_id long, data binary, error string")
    assert all(r["error"] and r["npy"] is None for r in media.media_tiles(table).collect())


def test_difference_hash_and_tiles_against_plain_means(spark, tmp_path):
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 256, (16, 27, 3)).astype(np.uint8)
    cell = [[float(pixels[2 * i : 2 * i + 2, 3 * j : 3 * j + 3].mean()) for j in range(9)] for i in range(8)]
    bits = "".join("1" if cell[i][j] < cell[i][j + 1] else "0" for i in range(8) for j in range(8))
    assert int(media.difference_hash(pixels), 16) == int(bits, 2)
    media.write_tiles(media.media_tiles(spark.createDataFrame([(1, bytearray(media.encode_ppm(pixels))), (2, bytearray(b"x"))], "media_id long, data binary"), size=8, side=5), f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t").where("not failed").orderBy("tile_row", "tile_column").collect()
    small = np.rint(media.area_resize(pixels, 8, 8)).astype(np.uint8)
    assert [(r["tile_row"], r["tile_column"]) for r in back] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert all((media.read_tile(r["npy"]) == small[5 * r["tile_row"] : 5 * r["tile_row"] + 5, 5 * r["tile_column"] : 5 * r["tile_column"] + 5]).all() for r in back)


def test_images(spark):
    grid = (np.arange(5 * 7 * 3) * 2 % 256).astype(np.uint8).reshape(5, 7, 3)
    assert (media.decode(media.encode_ppm(grid)) == grid).all()
    assert media.decode(b"P1\n# x\n3 2\n1 0 1\n010").ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert media.decode(b"P2 2 1 65535\n1 65535").ravel().tolist() == [1, 65535]
    assert media.decode(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    stride = -(-7 * 3 // 4) * 4
    body = b"".join(grid[r, :, ::-1].tobytes().ljust(stride, b"\0") for r in range(4, -1, -1))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)
    assert (media.decode(head + info + body) == grid).all()
    big = np.random.default_rng(2).integers(0, 256, (12, 8, 1)).astype(np.uint8)
    assert np.allclose(media.area_resize(big, 4, 2), big.reshape(4, 3, 2, 4, 1).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(big, 5, 3).mean(), big.mean())
    out = media.media_tiles(spark.createDataFrame([(1, bytearray(media.encode_ppm(grid))), (2, bytearray(b"BMxx")), (3, None)], "id long, data binary"), "id").collect()
    assert sum(r["media_id"] == 1 for r in out) == 4 and {r["media_id"]: r["error"] for r in out}[1] is None
    assert {r["media_id"] for r in out if r["error"]} == {2, 3}


def test_shards(docs, empty):
    out = sharding.shard_documents(docs, 5).collect()
    assert len(out) == len(rows()) and sharding.shard_documents(empty, 5).count() == 0
    by = {s: sorted((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1) for r in out if r["shard"] == s) for s in range(5)}
    last = -2
    for s in range(5):
        assert [x for x, _ in by[s]] == list(range(len(by[s])))
        for _, d in by[s]:
            assert d >= last
            last = d


def test_shards_against_prefix_sums(docs):
    order = sorted((-1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16) for r in rows())
    total, before, want, slots = sum(o[2] for o in order), 0, [], {}
    for d, crc, size in order:
        shard = min(4, (2 * before + size) * 5 // (2 * total))
        want.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs, 5).collect()]
    assert sorted(got) == sorted(want)


def test_shards_hot_key(spark):
    df = spark.createDataFrame([(7, "x" * (i % 5)) for i in range(300)] + [(i, "y" * 9) for i in range(300)], "doc_id long, text string")
    out = sharding.shard_documents(df, 6).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert max(r["s"] for r in out) - min(r["s"] for r in out) <= 2 * 25 and all(r["m"] == r["n"] - 1 for r in out)


def brute(data, words, num, den):
    sets = []
    for _, text in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(data)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return {d: (len(s), min(data[k][0] for k in range(len(data)) if root[k] == root[i])) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True))}


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80), (1, 100), (2, 50)])
def test_ngram_components(spark, words, num):
    rng = random.Random(words)
    vocab = [f"w{i}" for i in range(40)]
    data = []
    for base in range(12):
        text = rng.choices(vocab, k=rng.choice([2, 4, 9, 10, 11, 20, 40, 120, 300]))
        for _ in range(rng.choice([1, 3, 9])):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [own[k], rng.choice(vocab)]])
                own = own or ["w0"]
            data.append((len(data), " ".join(own)))
    data += [(len(data) + i, x) for i, x in enumerate([None, "", " ", "W1 w2", "w1  W2", "A", "a"])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = by_id(ngram_components(df, words, num, 100), "n_shingles", "component_id")
    assert got == brute(data, words, num, 100)


def test_ngram_edges(docs, empty):
    out = ngram_components(docs, 5, 80, 100)
    assert out.count() == len(rows()) and ngram_components(empty).count() == 0
    got = by_id(out, "component_id", "n_shingles")
    want = brute([(r[0], r[1]) for r in rows() if r[0] is not None], 5, 80, 100)
    assert all(got[d] == (c, n) for d, (n, c) in want.items())
    assert got[60] == (60, 0) and got[67][0] == got[68][0] == 67 and got[None][0] is None


def test_block_digests_lose_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) > rng.choice([0, 0.02, 0.06])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 20))).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        linked = 10 * inter >= 9 * (len(a) + len(b) - inter) and len(b) > 0
        if linked and not np.array_equal(a, b):
            bands = Bands(90, 100)
            assert np.intersect1d(block_digests(a, bands), block_digests(b, bands)).size
        if len(b):
            assert bool(len(multiply([a], [b], np.ones((1, 1), bool), 90, 100)[0])) == linked


@pytest.mark.parametrize("block", [3, 50, 2048])
def test_tile_product_equals_plain_overlaps(monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(block)
    bases = [np.unique(rng.integers(0, 90, int(rng.integers(1, 80))).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.05], rng.integers(0, 200, int(rng.integers(0, 3))).astype(np.uint64)])) for b in bases for _ in range(7)]
    a, b = sets[:25], sets[15:]
    able = rng.random((len(a), len(b))) > 0.3
    got = set(zip(*[x.tolist() for x in multiply(a, b, able, 80, 100)], strict=True))
    plain = lambda x, y: len(x) and len(y) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if able[i, j] and plain(x, y)} and got


def test_sketches_keep_every_linked_row_and_leave_others_out():
    rng = np.random.default_rng(11)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    passage, kept, far = draw(8), 0, 0
    for _ in range(60):
        base = draw(int(rng.integers(1, 900)))
        near = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.04], draw(1 + len(base) // 30)])) for _ in range(4)]
        other = [np.unique(np.concatenate([passage, draw(len(base))])) for _ in range(4)]
        a, b = [np.unique(base), *other[:2]], [*near, *other[2:]]
        able = np.ones((len(a), len(b)), bool)
        x, y = within_reach([sketch(s) for s in a], [sketch(s) for s in b], np.array([len(s) for s in a]), np.array([len(s) for s in b]), able, 80, 100)
        i, j = multiply(a, b, able, 80, 100)
        assert x[i].all() and y[j].all()
        kept, far = kept + len(i), far + int(x[1:].sum() + y[4:].sum())
    assert kept > 100 and far < 24  # of 240 rows that only share a passage, which is nearly all of a few short ones


def test_large_group_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 5)
    monkeypatch.setattr(ngram_join, "ENTRIES", 150)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(60)] = f"x{rng.randrange(9)}"
        data.append((i, " ".join(own)))
    got = by_id(ngram_components(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 3, 90, 100), "n_shingles", "component_id")
    assert got == brute(data, 3, 90, 100)


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({out[i] for i in range(41)}) == 1 and len({out[100 + i] for i in range(30)}) == 1 and out[0] != out[100]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(300):
        v = rng.normal(size=16)
        if i % 3 == 1:
            v = np.array(data[-1][1]) + rng.normal(size=16) * 0.05
        data.append((i, [float(np.float32(x)) for x in v], int(i % 2 if i % 3 == 0 else data[-1][2] if i % 3 == 1 else 0)))
    data += [(300, data[0][1], data[0][2]), (301, [x * 2 for x in data[0][1]], data[0][2]), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("nan")] * 16, 1), (305, [], 1), (306, data[0][1], None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.link_vectors(df).collect()}
    assert len(got) == len(data)
    usable = [(i, np.float32(v).astype(float), lab) for i, v, lab in data if v and lab is not None and np.isfinite(v).all() and np.any(v)]
    links = {(i, j) for i, a, x in usable for j, b, y in usable if i < j and x == y and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93}
    want = {i: sum(i in p for p in links) for i, *_ in data}
    assert sum(got[i][0] for i in got) >= 0.95 * sum(want.values()) and all(got[i][0] <= want[i] for i in got)
    assert got[306] == (0, 306, True) and got[300][1] == 0 and not got[300][2]
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0


def made_vectors(kind, n, d, seed=1):
    """Unit vectors with near copies: isotropic, in clusters, or around a common direction of mean cosine 0.8."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    if kind == "clustered":
        v = 0.45 * v + rng.normal(size=(20, d))[rng.integers(0, 20, n)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "shifted":
        v = np.sqrt(0.2) * v + np.sqrt(0.8) * np.eye(d)[0]
    for i in range(0, n, 4):  # near copies at cosines about the bound and above
        v[i + 1] = v[i] + rng.normal(size=d) * rng.uniform(0.1, 0.45) * np.linalg.norm(v[i]) / np.sqrt(d)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def true_links(v, cosine=0.93):
    return np.triu(v @ v.T >= cosine, 1)


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "shifted"])
def test_embedding_recall(spark, kind):
    v = made_vectors(kind, 1600, 24)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    want = true_links(v)
    degree = want.sum(axis=0) + want.sum(axis=1)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_vectors(df).collect()}
    assert all(got[i] <= degree[i] for i in got) and sum(got.values()) >= 0.95 * degree.sum() > 0
    if kind == "clustered":
        exact = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_vectors(df, exact=True).collect()}
        assert [exact[i] for i in range(1600)] == degree.tolist()


def test_small_labels_lose_no_link(spark):
    v = made_vectors("shifted", 220, 24)
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    own = (np.arange(220)[:, None] - np.arange(220)[None, :]) % 2 == 0
    want = true_links(v) & own
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_vectors(df).collect()}
    assert [got[i] for i in range(220)] == (want.sum(axis=0) + want.sum(axis=1)).tolist() and want.any()


def test_long_lists_are_split_without_double_counts(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 40)
    v = made_vectors("clustered", 900, 12)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    want = true_links(v)
    degree = want.sum(axis=0) + want.sum(axis=1)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_vectors(df).collect()}
    assert all(got[i] <= degree[i] for i in got) and sum(got.values()) >= 0.95 * degree.sum() > 0


def test_embedding_awkward_rows(spark):
    data = [(None, [1.0, 0.0], 1, 5, "a"), (3, [1.0, 0.0], 1, 6, "b"), (3, [1.0, 0.0], 1, 7, "c"), (2, [2.0, 0.0], 1, 8, None), (4, [1.0, None], 1, 9, "d"), (5, [1.0], 1, 1, "e"), (6, [0.0, 1.0], 1, 2, "f")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, entry int, unit string")
    got = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.link_vectors(df).collect())
    assert got == [(-1, 0, None, None), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]


def test_packing(docs, empty):
    out = packing.pack_documents(docs, capacity=512, group_rows=20).collect()
    source = {r[0]: r[3] for r in rows()}
    bins = {}
    for r in out:
        bins.setdefault((r["group"], r["bin"]), []).append(r)
    for own in bins.values():
        assert sum(r["size"] for r in own) <= 512
        named = [source[r["doc_id"]] for r in own if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
    assert sum(r["size"] for r in out) == sum(len((r[1] or "").encode()) for r in rows())
    assert packing.pack_documents(empty).count() == 0


def test_bins_of_groups_are_put_together(spark):
    rng = random.Random(2)
    data = [(i, 0, rng.randint(20, 60), f"s{rng.randrange(40)}", rng.randrange(60) if i % 3 else None) for i in range(400)] + [(None, 0, None, None, None)] * 2
    df = spark.createDataFrame(data, "doc_id long, piece int, size long, source string, cluster long")
    fill = {}
    for rounds in (0, 1, 2):
        out = packing.pack(df, 200, group_rows=13, rounds=rounds).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in out) == sorted((d[0] if d[0] is not None else -1, d[2] or 0) for d in data)
        bins = {}
        for r in out:
            bins.setdefault((r["group"], r["bin"]), []).append(r)
        by = {d[0]: d for d in data}
        for own in bins.values():
            taken = sorted((r["offset"], r["offset"] + r["size"]) for r in own)
            assert taken[-1][1] <= 200 and all(a[1] <= b[0] for a, b in zip(taken, taken[1:], strict=False))
            for k in (3, 4):
                named = [by[r["doc_id"]][k] for r in own if by[r["doc_id"]][k] is not None]
                assert len(named) == len(set(named))
        fill[rounds] = sum(r["size"] for r in out) / (200 * len(bins))
    assert fill[0] < fill[1] <= fill[2] + 1e-9


def test_best_fit_against_brute_force():
    rng = random.Random(8)
    for _ in range(100):
        sizes = sorted((rng.randint(0, 50) for _ in range(40)), reverse=True)
        masks = [1 << rng.randrange(5) | 1 << (5 + rng.randrange(12)) for _ in sizes]
        loads, bits, want = [], [], []
        for s, m in zip(sizes, masks, strict=True):
            fits = [b for b in range(len(loads)) if 60 - loads[b] >= s and not bits[b] & m and loads[b] < 60]
            b = min(fits, key=lambda b: (60 - loads[b], b)) if fits else len(loads)
            if b == len(loads):
                loads.append(0)
                bits.append(0)
            want.append((b, loads[b]))
            loads[b] += s
            bits[b] |= m
        assert packing.best_fit(sizes, masks, 60) == want


def test_mixing(docs, empty, spark):
    weights = spark.createDataFrame([("s0", 5.0), ("s1", 3.0), ("s2", 1.0), ("s3", None), ("gone", 9.0)], "source string, weight double")
    for given in (None, weights):
        out = mixing.schedule(docs, given, block_bytes=128, least=50).collect()
        assert len(out) == len(rows())
        blocks = {(r["source"], r["block"]): (r["release"], r["slot"], r["deadline"]) for r in out}
        assert len({b[1] for b in blocks.values()}) == len(blocks) and all(r <= s < d for r, s, d in blocks.values())
    assert mixing.schedule(empty).count() == 0


def fluid(sources, t):
    """{source: blocks it should have had after t slots} for {source: (blocks, weight)}, by exact fractions."""
    had, left = dict.fromkeys(sources, Fraction(0)), Fraction(t)
    while left:
        live = {s: Fraction(w) for s, (n, w) in sources.items() if had[s] < n}
        total = sum(live.values())
        step = min(left, *[(sources[s][0] - had[s]) * total / w for s, w in live.items()])
        for s, w in live.items():
            had[s] += step * w / total
        left -= step
    return had


def pfair(sources):
    """[(source, block, release, deadline)] slot by slot: brute force for {source: (blocks, weight)}, by exact fractions."""
    slots, out, done = sum(n for n, _ in sources.values()), [], dict.fromkeys(sources, 0)
    target = [fluid(sources, t) for t in range(slots + 1)]
    for t in range(slots):
        due = [(Fraction(done[s] + 1) / Fraction(w), s) for s, (n, w) in sources.items() if done[s] < n and target[t + 1][s] > done[s]]
        s = min(due)[1]
        release = max(x for x in range(slots + 1) if target[x][s] <= done[s])
        deadline = min(x for x in range(slots + 1) if target[x][s] >= done[s] + 1)
        assert release <= t < deadline
        out.append((s, done[s], release, deadline))
        done[s] += 1
        assert all(-1 < done[x] - target[t + 1][x] < 1 for x in sources)
    return out


@pytest.mark.parametrize(
    ("sources", "length"),
    [
        ({"a": (50, 50), "b": (1, 1), "c": (1, 1), "d": (30, 30), "e": (18, 18)}, 128),
        ({"a": (300, 7), "b": (40, 3), "c": (100, 2), "d": (3, 1)}, 100),
        ({"a": (200, 612370), "b": (1, 200), "c": (100, 333300), "d": (9, 54130)}, 64),
        ({f"s{i:02}": (1 + i * 7 % 5, 1 + i % 3) for i in range(40)}, 50),
    ],
)
def test_plan_keeps_each_source_within_a_block(spark, sources, length):
    df = spark.createDataFrame([(s, n, float(w)) for s, (n, w) in sources.items()], "source string, blocks long, weight double")
    whole = mixing.whole_weights(df, 1000)
    exact = {r["source"]: (r["blocks"], r["w"]) for r in whole.collect()}
    got = sorted((r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in mixing.plan(whole, length).collect())
    assert [g[0] for g in got] == list(range(len(got))) and [g[1:] for g in got] == pfair(exact)


def test_many_small_sources_leave_the_large_one_its_share(spark):
    df = spark.createDataFrame([("big", 400, 0.5)] + [(f"s{i:04}", 1, 0.5 / 400) for i in range(400)], "source string, blocks long, weight double")
    slots = sorted(r["slot"] for r in mixing.plan(mixing.whole_weights(df, 1000)).where("source = 'big'").collect())
    assert all(abs(k + 1 - (s + 1) / 2) <= 1 for k, s in enumerate(slots))


def test_url_filters(spark):
    hosts = ["net", "a.net", "example.net", "m.example.net", "example.com", "x.y.example.com", "org", "b.org", "network", "Exa.ORG", ""]
    paths = ["", "/", "/en/", "/en/x", "/de/1?x=/fr/", "/fr/#a", "?/de/", "/en"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] * 2 + [None, "", "no host", "http://"]
    data = [(i, u) for i, u in enumerate(urls)]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "", "block"), ("org", "", "allow"), (None, "/", "block")]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(data, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), parts=5).collect()}
    for i, u in data:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, 0, None, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[2], best[3]), u
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(none, spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_url_filters_on_awkward_rows(spark):
    data = [(None, "http://a.net/x", "k", 3, "v"), (7, "http://a.net/x", "k", 3, "v"), (7, "http://a.net/x", "k", 3, "v"), (7, None, None, None, None), (8, "http://\U0010ffff.net/" + "p" * 50_000, "", 1, "")]
    df = spark.createDataFrame(data, "page_id long, url string, key string, run int, verdict string")
    rules = spark.createDataFrame([("net", "/", "block", "x"), ("net", "/", "block", "x"), (None, None, None, None)], "host string, path string, verdict string, sort_key string")
    got = sorted(repr((r["page_id"], r["host"], len(r["path"]), r["rule"], r["verdict"])) for r in urlfilter.judge(df, rules, parts=3).collect())
    want = [(None, "a.net", 2, "net/", "block"), (7, "a.net", 2, "net/", "block"), (7, "a.net", 2, "net/", "block"), (7, "", 0, None, "allow"), (8, "\U0010ffff.net", 50_001, "net/", "block")]
    assert got == sorted(map(repr, want))
    assert {r["verdict"] for r in urlfilter.judge(df, rules.limit(0)).collect()} == {"allow"}


def test_token_rollup(spark, tmp_path, docs, empty):
    rollup = tokencount.TokenRollup(spark, f"file://{tmp_path}/r", RANKS_FILE, "v1")
    names = "op string, doc_id long, seq long, text string, source string, lang string"
    change = lambda *rows: spark.createDataFrame(list(rows), names)
    enc = tokencount._encoding(rollup.ranks)
    n = lambda t: len(enc.encode_ordinary(t))
    assert rollup.totals().count() == 0
    first = change(("upsert", 1, 1, "hello world", "a", "en"), ("upsert", 2, 1, "one", "a", "en"), ("upsert", 2, 2, "two three", "b", None), ("upsert", None, 1, "x", "a", "en"), ("upsert", 3, 1, None, None, None))
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    assert rollup.commit("2", change(("delete", 1, 1, None, None, None), ("delete", 9, 1, None, None, None), ("upsert", 2, None, "two three four", "b", None)))
    assert rollup.commit("3", change())
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert got == {("b", None): (1, n("two three four")), (None, None): (1, 0)}
    assert {r["doc_id"] for r in rollup.ledger().collect()} == {2, 3}
    counted = by_id(tokencount.count_tokens(docs, rollup.ranks), "tokens")
    assert all(counted[r[0]] == (n(r[1] or ""),) for r in rows())
    assert tokencount.count_tokens(empty, rollup.ranks).count() == 0


def test_rollup_names_never_meet_and_snapshots_change_nothing(spark, tmp_path):
    names = "op string, doc_id long, seq long, text string, source string, lang string, version string, sign int"
    plain, compact = (tokencount.TokenRollup(spark, f"file://{tmp_path}/{n}", RANKS_FILE, "a", compact_every=n) for n in (100, 2))
    enc, rng, truth = tokencount._encoding(plain.ranks), random.Random(4), {}
    for k, batch in enumerate(["b-c", "../x", "b/c", "b c", ".hidden"]):
        changes = [(rng.choice(["upsert", "upsert", "delete"]), rng.randrange(12), 1, " ".join(rng.choices("ab cd ef".split(), k=rng.randrange(1, 9))), rng.choice(["s", None]), "en", "clash", 7) for _ in range(6)]
        last = {}
        for c in changes:
            rank = (c[0] == "delete", len(enc.encode_ordinary(c[3])) if c[0] == "upsert" else 0, c[4] is not None)
            if c[1] not in last or rank > last[c[1]][0]:
                last[c[1]] = (rank, c)
        for d, (_, c) in last.items():
            truth.pop(d, None)
            if c[0] == "upsert":
                truth[d] = (c[4], len(enc.encode_ordinary(c[3])))
        for rollup in (plain, compact):
            assert rollup.commit(batch, spark.createDataFrame(changes, names)) and rollup.committed(batch) and not rollup.commit(batch, spark.createDataFrame(changes, names))
            assert {r["doc_id"]: (r["source"], r["tokens"]) for r in rollup.ledger().collect()} == truth, k
    other = tokencount.TokenRollup(spark, f"file://{tmp_path}/2", RANKS_FILE, "a-b")
    assert not other.committed("c") and other.commit("c", spark.createDataFrame([("upsert", 1, 1, "ab", "s", "en", "x", 1)], names))
    want = {}
    for source, n in truth.values():
        want[source] = (want.get(source, (0, 0))[0] + 1, want.get(source, (0, 0))[1] + n)
    assert {r["source"]: (r["n_docs"], r["n_tokens"]) for r in compact.totals().where("version = 'a'").collect()} == want
    assert compact.totals().where("version = 'a-b'").count() == 1


def test_pipeline_stages(spark, docs, empty, labels):
    import corpus_pipeline

    for start in (docs, empty):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = spark.createDataFrame(stage(spark, kept, labels).collect(), start.schema)
            assert kept.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, kept, labels)
        assert out.count() >= kept.count()
    ids = [r["doc_id"] for r in stages.near_duplicate_stage(spark, docs, labels).collect()]
    want = {d for d, (_, c) in brute([(r[0], r[1]) for r in rows() if r[0] is not None], 5, 80, 100).items() if d == c}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert stages.mixing_stage(spark, docs, labels).count() == len(rows())


def mixed_slots(kept, weights, block_bytes=65_536):
    """{doc_id: slot} by brute force: blocks in the order of (draw, doc_id), then the released block that must end first."""
    blocks, most = {}, {}
    for source in {r["source"] for r in kept}:
        before = 0
        for r in sorted((r for r in kept if r["source"] == source), key=lambda r: (r["draw"], r["doc_id"])):
            size = len(r["text"].encode()) + 16
            blocks[r["doc_id"]] = (source, int((before + size / 2) // block_bytes))
            most[source] = max(most.get(source, 0), blocks[r["doc_id"]][1] + 1)
            before += size
    slots = {b[:2]: at for at, b in enumerate(pfair({s: (most[s], round(weights[s] / max(weights[x] for x in most) * mixing.SCALE)) for s in most}))}
    return {d: slots[b] for d, b in blocks.items()}


def packed(kept, slots, capacity=16_384):
    """{(doc_id, piece, size, group, bin, offset, slot)} by brute force, a group for each run of 64 slots."""
    out = set()
    for group, run in enumerate(sorted({s // 64 for s in slots.values()})):
        pieces = []
        for r in kept:
            if slots[r["doc_id"]] // 64 == run:
                n = len(r["text"].encode())
                last = max(-(-n // capacity) - 1, 0)
                pieces += [(capacity if k < last else n - last * capacity, r["doc_id"], k, r["source"], r["text"]) for k in range(last + 1)]
        bins = []
        for size, doc, k, source, text in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
            fits = [(capacity - load, b) for b, (load, names) in enumerate(bins) if size <= capacity - load > 0 and source not in names and ("t", text) not in names]
            b = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append((0, set()))
            out.add((doc, k, size, group, b, bins[b][0], slots[doc]))
            bins[b] = (bins[b][0] + size, bins[b][1] | {source, ("t", text)})
    return out


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocab = [sorted(set(t.split()) - {"."}) for t in (GERMAN, ENGLISH, SPANISH)]
    data = []
    for i in range(170):
        text = " ".join(w + "." * (k % 12 == 11) for k, w in enumerate(f"{rng.choice(vocab[i % 3])}{rng.choice(['', '', rng.randrange(90)])}" for _ in range(rng.randrange(4200, 5200))))
        data.append((i, text, ("de", "en", "es")[i % 3], f"s{i % 7 % 3}"))
    data += [(200 + i, data[i][1] + " ende", data[i][2], data[i][3]) for i in range(0, 40, 5)]
    data += [(300, None, "en", "s0"), (301, "12 34!", "de", "s1")]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(170)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    draw = {r["doc_id"]: r["x"] for r in spark.createDataFrame([(d[0],) for d in data], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("x")).collect()}
    texts = [(d, t) for d, t, *_ in data if d < 300]  # without letters: no language; no label says toxic
    first = {d for d, (_, c) in brute(texts, 5, 80, 100).items() if d == c}
    assert first == set(range(170))
    kept = [{"doc_id": d, "text": t, "source": s, "draw": draw[d]} for d, t, _, s in data if d in first]
    seen = []
    for weights in ({"s0": 1.0, "s1": 1.0, "s2": 1.0}, {"s0": 90.0, "s1": 1.0, "s2": 9.0}):
        given = spark.createDataFrame(list(weights.items()), "source string, weight double")
        out = corpus_pipeline.run(spark, str(tmp_path), given).collect()
        seen.append({(r["doc_id"], r["piece"], r["size"], r["group"], r["bin"], r["offset"], r["slot"]) for r in out})
        assert len(out) == len(seen[-1])
        assert seen[-1] == packed(kept, mixed_slots(kept, weights))
    assert {x[:6] for x in seen[0]} != {x[:6] for x in seen[1]}


def test_runs_of_one_session_keep_their_own_slots(spark, docs, labels):
    first, second = docs.where("doc_id < 40").dropDuplicates(["doc_id"]), docs.where("doc_id between 20 and 59")
    slots = lambda df, **more: sorted((r["doc_id"], r["slot"]) for r in stages.packing_stage(spark, df, labels, **more).collect())
    want = {r["doc_id"]: r["slot"] for r in mixing.schedule(first, block_bytes=300).collect()}
    stages.mixing_stage(spark, first, labels, block_bytes=300).collect()
    stages.mixing_stage(spark, second, labels).collect()
    got = slots(first, block_bytes=300)
    assert set(got) == set(want.items()) and len({s for _, s in got}) > 3 and slots(second) != got


def test_repeated_ids_are_judged_by_their_own_text(spark, labels):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    data = [(1, one), (2, one + " end"), (2, two), (2, two), (3, three), (3, three + " end"), (4, two + " end"), (5, None), (5, ""), (None, one), (None, one)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(data)], "doc_id long, text string, n int")
    kept = [(r["doc_id"], r["text"]) for r in stages.near_duplicate_stage(spark, df, labels).collect()]
    third = [t for d, t in kept if d == 3]
    assert len(third) == 1 and third[0] in (three, three + " end")
    want = [(1, one), (2, two), (3, third[0]), (5, None), (5, ""), (None, one), (None, one)]
    assert sorted(map(repr, kept)) == sorted(map(repr, want))


def brute_manifest(rows, arity=3):
    """{doc position: (leaf, subroot, root, proof siblings, folded)} by plain recursion over lists."""
    def h(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def climb(nodes, at):
        beside = []
        while len(nodes) > 1:
            run = at - at % arity
            beside.append((nodes[run:at], nodes[at + 1 : run + arity]))
            nodes, at = [h(nodes[i : i + arity]) for i in range(0, len(nodes), arity)], at // arity
        return nodes[0], beside

    trees = {}
    for source, doc, leaf, found in rows:
        trees.setdefault(source, []).append((doc, leaf, found))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for own in trees.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = [climb([x[1] for x in trees[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        for i, (doc, leaf, found) in enumerate(trees[s]):
            subroot, low = climb([x[1] for x in trees[s]], i)
            root, high = climb(tops, k)
            node, said = found, ""
            for before, after in low + high:
                said += "".join(before + after)
                node = h([*before, node, *after])
            out.append((s, doc, leaf, subroot, root, said, node))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("height", "top"), [(7, 4096), (1, 5), (2, 3), (1, 100), (2, 30)])
def test_manifest_equals_brute_force(spark, height, top):
    from spanloom.llm import manifest

    rng = random.Random(height * 100 + top)
    sizes = {None: 5, "": 1, "a": 1, "é": 28, "b": 82, "z-hot": 120, **{f"s{i}": rng.randrange(1, 5) for i in range(12)}}
    rows = [(s, rng.randrange(60) if s == "b" else None if s is None and i < 2 else i, hashlib.sha256(f"{s}{i % 50}".encode()).hexdigest(), hashlib.sha256(b"x").hexdigest()) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "source string, doc_id long, leaf string, found string, rank int, subroot string").repartition(3)
    got = manifest.proofs(df, height=height, top=top)
    got = got.withColumns({"said": manifest.proof_text(F.col("left"), F.col("right")), "folded": manifest.folded(F.col("found"), F.col("left"), F.col("right")), "same": manifest.folded(F.col("leaf"), F.col("left"), F.col("right"))}).collect()
    assert all(r["same"] == r["root"] and r["rank"] == 1 for r in got)
    assert sorted(repr((r["source"], r["doc_id"], r["leaf"], r["subroot"], r["root"], r["said"], r["folded"])) for r in got) == brute_manifest(rows)
    own = {}
    for s, d, leaf, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        own.setdefault(s, []).append(leaf)
    assert list(manifest.plain_root(own))[-1] == got[0]["root"]


def test_manifest_of_awkward_tables(spark, docs, empty):
    from spanloom.llm import manifest

    assert manifest.proofs(empty.withColumn("leaf", manifest.leaf_digest())).count() == 0
    out = manifest.proofs(docs.withColumn("leaf", manifest.leaf_digest())).withColumn("back", manifest.folded(F.col("leaf"), F.col("left"), F.col("right"))).collect()
    assert len(out) == len(rows()) and all(r["back"] == r["root"] for r in out) and len({r["root"] for r in out}) == 1
    one = manifest.proofs(docs.where("doc_id = 3").withColumn("leaf", manifest.leaf_digest())).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["left"] == one["right"] == []
    said = "1:3" + "2:s3" + "2:de" + f"{len(str(one['n_chars']))}:{one['n_chars']}" + f"{len(one['text'].encode())}:{one['text']}"
    assert one["leaf"] == hashlib.sha256(said.encode()).hexdigest()
    none = docs.where("doc_id = 60").select(manifest.leaf_digest().alias("x")).first()["x"]
    assert none == hashlib.sha256(b"2:602:s02:en--").hexdigest()


def plain_resample(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    """{(doc_id, text): (n_features, weight, score, rank)} feature by feature."""
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [zlib.crc32(f.encode()) % buckets for f in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[f] += 1
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for d, text in docs:
        words, found = features(text)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return out


def test_resampling_equals_a_plain_draw(spark, docs, empty):
    from spanloom.llm import resample

    rng = random.Random(2)
    words = ["alpha", "Beta", "gämma", "日本", "x1", "a" * 70, "ÅB", "z"]
    data = [(i % 190 if i % 13 else None, " ".join(rng.choices(words, k=rng.randrange(45))) + rng.choice(["", ".", " -!", "\u0085q"])) for i in range(400)] + [(500, None), (501, ""), (502, "beta " * 300_000)]
    target = ["alpha beta", "x1 x1 gämma", None, "", "日本 z"]
    df = spark.createDataFrame([(*d, 7, 9) for d in data], "doc_id long, text string, rank long, score long").repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    want = plain_resample(data, target)
    for sizes in ({}, {"range_rows": 3, "page": 2}, {"range_rows": 1, "ranges": 1000}):
        got = resample.resample(df, goal, **sizes).collect()
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted((tuple(r) for r in got), key=key) == sorted((tuple(r[:5]) for r in want), key=key)
    assert resample.resample(empty, goal).count() == 0
    assert resample.resample(docs, goal.limit(0)).where("rank is not null").count() == sum(len(re.findall(r"\w+", r[1] or "")) >= 20 for r in rows()) // 4
    assert resample.resample(docs, goal, least_words=10**7).where("rank is not null").count() == 0


def test_heavy_scores_are_cut_at_ids(spark, tmp_path):
    from spanloom.llm import resample

    data = [(i if i % 50 else None, 1, 0, 5 if i % 3 else i % 7, i % 11 > 0) for i in range(900)]
    spark.createDataFrame(data, "doc_id long, n_features long, weight long, score long, eligible boolean").repartition(6).write.parquet(f"{tmp_path}/s")
    got = resample.draw(spark.read.parquet(f"{tmp_path}/s"), 300, range_rows=20, ranges=1000, page=8).collect()
    fit = sorted((r for r in data if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[:300]
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert len(got) == 900 and [r["rank"] for r in drawn] == list(range(1, 301)) and [(r["doc_id"], r["score"]) for r in drawn] == [(r[0], r[3]) for r in fit]


def test_tournament_merges_any_pages():
    from spanloom.llm import resample

    rng = random.Random(9)
    for n in (0, 1, 2, 3, 17, 100):
        pages = [sorted((rng.randrange(50), i) for i in range(rng.randrange(1, 6))) for _ in range(n)]
        pages = sorted(([(k, (k, i)) for k, i in p] for p in pages), key=lambda p: p[0][0])
        every = sorted(r for p in pages for _, r in p)
        for most in (0, 3, 10**6):
            got = list(resample.merged(pages, most))
            assert [k for k, _ in got[:most]] == [k for k, _ in every[:most]] and sorted(got) == every


def test_word_runs_of_chunks_and_long_words(monkeypatch):
    from spanloom.llm import resample

    rng = random.Random(4)
    texts = ["", "one", "Two words", "x" * 500 + " " + "y" * 49, "é ü", " ".join(rng.choices(["ab", "c", "d" * 48, "e1"], k=40)), "--", "tail"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for chunk in (1, 3, 1 << 17):
        monkeypatch.setattr(resample, "CHUNK", chunk)
        got = [[] for _ in texts]
        for a, word, b, pair in resample.word_runs(data, offsets):
            for t, c in [*zip(a.tolist(), word.tolist(), strict=True), *zip(b.tolist(), pair.tolist(), strict=True)]:
                got[t].append(c)
        for t, text in enumerate(texts):
            w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
            assert sorted(got[t]) == sorted(zlib.crc32(f.encode()) for f in [*w, *[" ".join(p) for p in zip(w, w[1:], strict=False)]])


def test_quality_votes_equal_plain_cosines(spark, docs, empty):
    from spanloom.llm import neighbours

    rng = random.Random(1)
    good = [" ".join(rng.choices("the cat sat on a warm mat near some old door".split(), k=40)) + "." for _ in range(60)]
    bad = ["$$$ " * rng.randrange(20, 60) + rng.choice(good) for _ in range(30)] + ["buy " * rng.randrange(30, 90) for _ in range(30)]
    data = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(bad)]
    df = spark.createDataFrame([(*d, 0.5) for d in data], "doc_id long, text string, quality int, score double")
    model = neighbours.fit(df.where("doc_id % 4 > 0"), dimensions=16, nearest=5)
    assert model.space.shape == (neighbours.WIDTH, 16) and np.allclose(model.space.T @ model.space, np.eye(16), atol=1e-6)
    out = by_id(neighbours.score(df, model), "score", "predicted")
    assert all(out[d][1] == y for d, _, y in data) and all(0 <= s <= 1 for s, _ in out.values())
    for d, text, _ in data[::9]:  # every product and every vote by itself
        raw = text.encode()
        tf = neighbours.counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        z = (np.sqrt(tf) * model.idf) @ model.space
        cosine = [max(0.0, float(v @ z / np.linalg.norm(z))) for v in model.vectors]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[:5]
        near = [k for k in range(len(cosine)) if cosine[k] >= cosine[near[-1]] - 1e-12]
        vote = sum(cosine[k] ** model.sharpness * model.label[k] for k in near) / sum(cosine[k] ** model.sharpness for k in near)
        assert abs(vote - out[d][0]) < 1e-6
    scored = neighbours.score(docs, model)
    got = by_id(scored, "score")
    assert scored.count() == len(rows()) and got[60] == got[61] == (model.share,) and got[65] == got[66]
    assert neighbours.score(empty, model).count() == 0
    none = neighbours.fit(df.limit(0))
    assert {r["score"] for r in neighbours.score(docs, none).collect()} == {0.5}
    lone = neighbours.fit(df.where("quality = 1").limit(1))
    assert {r["predicted"] for r in neighbours.score(docs, lone).collect()} == {1}


def test_quality_features_of_pieces_and_neighbours(monkeypatch):
    from spanloom.llm import neighbours

    rng = random.Random(8)
    texts = ["".join(rng.choices("aZé0 .\n$日", k=rng.randrange(60))) for _ in range(50)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = neighbours.counts(data, offsets)
    assert all((neighbours.counts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] == whole[i]).all() for i, r in enumerate(raw))
    assert (whole[:, : neighbours.SHAPES].sum(axis=1) == [sum(max(0, len(t) - k) for k in range(3)) for t in texts]).all()
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(neighbours, "PIECE", piece)
        assert (neighbours.counts(data, offsets) == whole).all()


def test_resizing_in_pieces_is_exact():
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (3, 5), (70, 33), (8, 9)):
        pixels = rng.integers(0, 256, (h, w, 2), dtype=np.uint8)
        wide = np.kron(pixels.astype(float), np.ones((8, 9, 1)))
        want = wide.reshape(8, h, 9, w, 2).mean(axis=(1, 3))
        for side in (1, 4, 512):
            assert np.allclose(media.area_resize(pixels, 8, 9, side), want)
    with pytest.raises(media.BadImage):
        media.decode(b"P4 100000 100000\n" + b"x")
    with pytest.raises(media.BadImage):
        media.decode(b"P1 10000 10000\n1")


def test_long_texts_are_counted_in_pieces(monkeypatch):
    with open(RANKS_FILE, "rb") as f:
        encoding = tokencount._encoding(f.read())
    rng = random.Random(6)
    text = "".join(rng.choices(["word", " a", " 12", "it's", "  ", "\n", " ½x", "é ", "日本", "_", " ²b"], k=3000))
    monkeypatch.setattr(tokencount, "PIECE", 40)
    own = list(tokencount.pieces(text))
    assert len(own) > 50 and "".join(own) == text and sum(len(encoding.encode_ordinary(p)) for p in own) == len(encoding.encode_ordinary(text))


def plain_bins(rows, capacity):
    """Bins (lists of rows) by looking at every bin for the tightest one that fits and repeats no source or cluster."""
    bins = []
    for r in rows:
        free = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins)]
        fits = sorted((f, k) for f, k in free if f >= r[0] and f > 0 and not any(set(x[1]) & set(r[1]) for x in bins[k]))
        if fits:
            bins[fits[0][1]].append(r)
        else:
            bins.append([r])
    return bins


@pytest.mark.parametrize("rounds", [0, 1])
def test_packing_equals_a_plain_search_over_all_groups(spark, rounds):
    rng = random.Random(rounds + 5)
    data = [(i, 0, rng.choice([0, 5, 17, 30, 44, 60]), rng.choice(["a", "b", "c", None, f"s{i}"]), rng.choice([None, i % 9, i])) for i in range(150)]
    pieces = spark.createDataFrame(data, "doc_id long, piece int, size long, source string, cluster long")
    groups = -(-len(data) // 20)
    dealt = {r["doc_id"]: r["g"] for r in pieces.select("doc_id", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("g")).collect()}
    want = {}
    for g in range(groups):
        own = sorted((r for r in data if dealt[r[0]] == g), key=lambda r: (-r[2], r[0]))
        rows_ = [(r[2], [x for x in (("s", r[3]), ("c", r[4])) if x[1] is not None], r[0]) for r in own]
        for b, members in enumerate(plain_bins(rows_, 64)):
            want[g, b] = members
    if rounds:
        part = [(g, b, sum(x[0] for x in own)) for (g, b), own in want.items() if sum(x[0] for x in own) < 64]
        n = max(1, -(-len(part) // 20))
        again = {(r["from"], r["bin"]): r["g"] for r in spark.createDataFrame(part, "from long, bin long, size long").select("from", "bin", F.pmod(F.xxhash64("from", "bin", F.lit(0)), F.lit(n)).alias("g")).collect()}
        for k in range(n):
            own = sorted((x for x in part if again[x[0], x[1]] == k), key=lambda x: (-x[2], x[0], x[1]))
            for merged in plain_bins([(size, [y for m in want[g, b] for y in m[1]], (g, b)) for g, b, size in own], 64):
                for _, _, place in merged[1:]:
                    want[merged[0][2]] = want[merged[0][2]] + want.pop(place)
    got = {}
    for r in packing.pack(pieces.repartition(3), 64, group_rows=20, rounds=rounds).collect():
        got.setdefault((r["group"], r["bin"]), []).append((r["offset"], r["doc_id"], r["size"]))
    assert {k: [d for _, d, _ in sorted(v, key=lambda x: (x[0], -x[2]))] for k, v in got.items() if all(s for *_, s in v)} == {k: [m[2] for m in v] for k, v in want.items() if all(m[0] for m in v)}
    assert {k: sorted(d for _, d, _ in v) for k, v in got.items()} == {k: sorted(m[2] for m in v) for k, v in want.items()}


def test_written_shards_hold_their_documents_in_order(spark, tmp_path):
    data = [(i, "x" * (i * 7 % 50)) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame([(*d, "clash") for d in data], "doc_id long, text string, size string").repartition(4)
    sharding.write_shards(df, f"{tmp_path}/s", 5)
    back = spark.read.parquet(f"{tmp_path}/s")
    placed = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 5).collect()}
    assert sorted((r["doc_id"], r["text"] or "", r["shard"]) for r in back.collect()) == sorted((d, t or "", placed[d]) for d, t in data)
