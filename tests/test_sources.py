"""The paged reader over a service that fails, cuts and repeats; keys shared down policy trees."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import shares
from spanloom.functions.durable import durable
from spanloom.operators import access, trees
from spanloom.sources import paged

WANT = [(k, None if k % 11 == 0 else f"w{k}") for k in range(537)]


def reader(spark, kind, fetch="tests.paged_service:fetch"):
    paged.register(spark)
    return kind.format("paged").schema("n long, word string").option("fetch", fetch).option("page", 10).option("pages", 4).option("wait", 0.01)


def test_no_row_is_lost_or_doubled(spark):
    rows = reader(spark, spark.read).load()
    assert rows.rdd.getNumPartitions() == 14 and sorted(tuple(r) for r in rows.collect()) == WANT
    with pytest.raises(Exception, match="gone"):
        reader(spark, spark.read, "tests.paged_service:gone").option("retries", 1).load().collect()


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    def run():
        stream = reader(spark, spark.readStream).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)

    run()
    run()  # nothing new: nothing is read again
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == WANT


TREES = [
    "a", shares.every("a", "b"), shares.either("a", "b", "c"), shares.gate(2, "a", "b", "c", "d"),
    shares.either(shares.every("a", "b"), shares.gate(2, "b", "c", shares.either("d", "e"))), shares.gate(3, "a", "a", "b", shares.every("c", "d", "e")),
]


def test_shares_come_back_exactly_where_the_policy_holds():
    rng = random.Random(4)
    for tree in TREES:
        secret = rng.randrange(shares.PRIME)
        leaves = list(shares.split(tree, secret, b"seed"))
        for n in range(6):
            for owned in itertools.combinations("abcde", n):
                got = shares.joined(tree, {p: v for p, a, v in leaves if a in owned})
                assert got == (secret if shares.holds(tree, set(owned)) else None)
    assert len({v for _, _, v in shares.split(TREES[3], 5, b"x")} & {v for _, _, v in shares.split(TREES[3], 5, b"y")}) == 0
    for bad in (shares.gate(0, "a"), shares.gate(3, "a", "b")):
        with pytest.raises(ValueError):
            shares.written(bad)


def test_holders_open_what_their_attributes_allow(spark):
    rows = [(i, "RED", shares.written(t), bytes([i + 1]) * 32) for i, t in enumerate(TREES)] + [(90, "RED", None, b"x" * 32), (91, "RED", shares.written("a"), None)]
    keys = spark.createDataFrame(rows, "id long, tier string, policy string, key binary")
    leaves = durable(trees.wrap_by_tree(keys, b"root"), "leaves")
    people = {"one": "a", "two": "bc", "three": "abd", "all": "abcde", "none": "z"}
    held = spark.createDataFrame([(p, a) for p, own in people.items() for a in own], "holder string, attribute string").withColumn("key", access.copy_key(b"root", F.col("attribute")))
    got = {(r["holder"], r["id"]): bytes.fromhex(r["key"]) for r in trees.open_by_tree(leaves, held).collect()}
    assert got == {(p, i): bytes([i + 1]) * 32 for p, own in people.items() for i, t in enumerate(TREES) if shares.holds(t, set(own))}
    wrong = held.withColumn("key", access.copy_key(b"other", F.col("attribute")))
    assert trees.open_by_tree(leaves, wrong).count() == 0
