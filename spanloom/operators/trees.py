"""Copies' keys under policy trees: shared down AND, OR and k-of-n gates, each leaf sealed under its attribute's key.

Whoever holds the keys of enough attributes opens a copy, without asking anybody.  Unlike pairing-based encryption an
attribute has one key for all its holders: holders who pool their attributes open together what none may open alone, and
a key can't be taken back from one of them only.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import keyed, shares
from spanloom.operators import access

LEAF = "path string, attribute string, share string"


def wrap_by_tree(keys: DataFrame, secret: bytes) -> DataFrame:
    """(id, tier, policy, path, attribute, wrapped): a row for each leaf of the policies of keys (id, tier, policy, key).

    policy is the text of a tree (shares.written), key has 32 bytes.  Write the result before it is read twice: every
    sealing draws a nonce.  A null key or policy has no rows: such a copy stays closed.
    """
    seed = keyed.subkey(secret, "shares")

    def rows(batches):
        for batch in batches:
            at, out = [], []
            for i, (key, policy, tag) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "policy", "tag")), strict=True)):
                number = int.from_bytes(key, "big")
                if number >= shares.PRIME or len(key) != 32:
                    raise ValueError("a key must have 32 bytes and be below the prime")
                leaves = list(shares.split(json.loads(policy), number, seed + tag.encode() + key))
                at += [i] * len(leaves)
                out += [(p, a, f"{v:064x}") for p, a, v in leaves]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("id", "tier", "policy")]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, pa.string()) for c in columns]], ["id", "tier", "policy", "path", "attribute", "share"])

    own = keys.where("key is not null and policy is not null").select("id", "tier", "policy", "key", F.concat_ws("|", F.col("id").cast("string"), "tier").alias("tag"))
    schema = own.select("id", "tier", "policy").schema
    for name in ("path", "attribute", "share"):
        schema = schema.add(name, "string")
    named = F.concat_ws("|", "tier", "path")
    return own.mapInArrow(rows, schema).select("id", "tier", "policy", "path", "attribute", access.seal(F.col("share"), access.copy_key(secret, F.col("attribute")), F.col("id"), named).alias("wrapped"))


def open_by_tree(leaves: DataFrame, attribute_keys: DataFrame) -> DataFrame:
    """(id, tier, holder, key): the keys (hex) of the copies that a holder's attributes open; others have no row.

    leaves: what wrap_by_tree gave, written.  attribute_keys: (holder, attribute, key), a holder's few keys.  Only leaves of
    held attributes are unsealed; a copy's shares meet in one row for each holder.
    """
    held = leaves.join(F.broadcast(attribute_keys.withColumnRenamed("key", "own")), "attribute")
    share = access.unseal(F.col("wrapped"), F.col("own"), F.col("id"), F.concat_ws("|", "tier", "path"))
    found = held.select("id", "tier", "policy", "holder", "path", share.alias("share")).where("share is not null")
    by_copy = found.groupBy("id", "tier", "policy", "holder").agg(F.map_from_entries(F.collect_set(F.struct("path", "share"))).alias("shares"))

    def rows(batches):
        for batch in batches:
            keys = []
            for policy, known in zip(batch.column("policy").to_pylist(), batch.column("shares").to_pylist(), strict=True):
                number = shares.joined(json.loads(policy), {p: int(v, 16) for p, v in known})
                keys.append(None if number is None else f"{number:064x}")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "tier", "holder")], pa.array(keys, pa.string())], ["id", "tier", "holder", "key"])

    schema = by_copy.select("id", "tier", "holder").schema.add("key", "string")
    return by_copy.mapInArrow(rows, schema).where("key is not null")
