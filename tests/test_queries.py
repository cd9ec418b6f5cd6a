"""Every registered query of the core against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from spanloom.operators import audit
from spanloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
registry.load()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    rows = registry.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in rows.collect())
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_merkle_root_of_ids_with_gaps_and_repeats(spark, tmp_path):
    own = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 7 <> 3").limit(50)
    own.unionByName(own.orderBy("event_id").limit(3)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    mine = [r["root"] for r in registry.QUERIES["merkle_root"](spark, str(tmp_path)).collect()]
    assert mine == [r[0] for r in con.execute(registry.ORACLES["merkle_root"]).fetchall()]


def test_appended_entries_have_no_gaps(spark):
    fresh = spark.createDataFrame([(f"entry{i}",) for i in range(40)], "entry string").repartition(5)
    log = audit.append_entries(spark.createDataFrame([(6,)], "seq long"), fresh, ["entry"]).collect()
    assert {r["seq"]: r["entry"] for r in log} == dict(enumerate(sorted(f"entry{i}" for i in range(40)), 7))
