"""A log appended in batches: roots, stored nodes and proofs equal a rebuild, and old entries are never read."""

import hashlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from spanloom.operators import audit, growing


def leaf(i):
    return hashlib.sha256(b"\0" + str(i).encode()).hexdigest()


def plain(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return growing._join(plain(leaves[:k]), plain(leaves[k:]))


def test_peaks_give_the_root_of_every_size():
    peaks, roots = [], []
    for i in range(2051):
        peaks = growing.pushed(peaks, 0, [(i, leaf(i))])
        roots.append(growing.root_of(peaks))
    for n in (*range(1, 70), 127, 128, 1000, 1023, 1024, 1025, 2047, 2048, 2049, 2050):
        assert roots[n - 1] == plain([leaf(i) for i in range(n)])
    assert growing.root_of([]) is None


def rows(spark, a, b):
    return spark.createDataFrame([(i, leaf(i)) for i in range(a, b)], "pos long, hash string").repartition(3)


def test_batches_end_as_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "STEP", 3)
    monkeypatch.setattr(audit, "STEP", 3)
    log, size, sizes = growing.GrowingLog(spark, f"file://{tmp_path}/log"), 0, []
    for n in (1, 6, 2, 60, 1, 130):
        size = log.append(rows(spark, size, size + n))
        sizes.append(size)
        assert log.root() == plain([leaf(i) for i in range(size)])
    levels = log.levels()
    for pos in random.Random(1).sample(range(size), 4):
        assert audit.verify_inclusion(leaf(pos), pos, size, log.inclusion(pos), log.root())
    assert audit.verify_inclusion(leaf(5), 5, 69, audit.inclusion_proof(levels, 5, 69), plain([leaf(i) for i in range(69)]))
    assert audit.verify_consistency(69, size, plain([leaf(i) for i in range(69)]), log.root(), log.consistency(69))
    assert [r["size"] for r in log.heads().orderBy("size").collect()] == sizes
    with pytest.raises(ValueError):
        log.append(rows(spark, size + 1, size + 3))
    assert log.append(rows(spark, 0, 0)) == size


def test_appending_reads_no_old_entry_and_repairs_half_a_batch(spark, tmp_path):
    log = growing.GrowingLog(spark, f"file://{tmp_path}/log")
    log.append(rows(spark, 0, 5000))
    shutil.rmtree(f"{tmp_path}/log/levels/0/from=0")  # the old entries are out of reach
    rows(spark, 0, 3).write.parquet(f"file://{tmp_path}/log/levels/0/from=5000")  # what a failed writer left
    assert log.append(rows(spark, 5000, 6000)) == 6000
    assert log.root() == plain([leaf(i) for i in range(6000)])
    nodes = spark.read.parquet(f"{tmp_path}/log/levels/1/*").orderBy("pos").collect()
    assert [(r["pos"], r["hash"]) for r in nodes] == [(k, plain([leaf(i) for i in range(1024 * k, 1024 * k + 1024)])) for k in range(5)]
    assert spark.read.parquet(f"{tmp_path}/log/levels/0/from=5000").where(F.col("pos") < 5000).count() == 0


def test_many_heads_are_checked_at_once(spark, monkeypatch):
    monkeypatch.setattr(audit, "HEADS", 150)
    entries = spark.createDataFrame([(i, str(i), leaf(i)) for i in range(400)], "seq long, entry string, hash string").repartition(3)
    heads, peaks = [], []
    for i in range(400):
        peaks = growing.pushed(peaks, 0, [(i, leaf(i))])
        heads.append({"size": i + 1, "root": growing.root_of(peaks)})
    assert audit.verify_log(entries, F.col("entry"), heads) == {"first_bad": None, "truncated_below": None, "first_bad_head": None}
    heads[233] |= {"root": "00" * 32}
    assert audit.verify_log(entries, F.col("entry"), heads)["first_bad_head"] == 234
