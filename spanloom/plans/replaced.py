"""Queries over replacements of every type: coarser values, surrogates, and spans carried over to another transcript."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import keyed
from spanloom.functions import values as V
from spanloom.operators import render, spans
from spanloom.plans.calls import CALLS, SECRET, sql_hmac, table
from spanloom.plans.registry import query
from spanloom.sources import transcripts as tr

#: Surfaces that customers are given in turn, of the types that have coarser values of their own.
SURFACES = (
    [("EMPLOYER", e) for e in V.EMPLOYERS] + [("OCCUPATION", o) for o in V.OCCUPATIONS] + [("OCCUPATION", "juggler"), ("EMPLOYER", "Acme")]
    + [("NATIONALITY", n) for n in V.LEXICONS["NATIONALITY"]] + [("NATIONALITY", "Singaporean"), ("SWIFT", "DBSSSGSG"), ("SWIFT", "NWBKGB2L")]
    + [("DATE", f"3 {m}") for m in V.MONTHS] + [("DATE", "the third"), ("DOB", "12 May 1984"), ("DOB", "12 may"), ("DOB", "long ago"), ("PASSPORT", "E1234567K")]
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pairs(name: str, table_: dict[str, str]) -> str:
    return f"{name}(k, v) AS (VALUES " + ", ".join(f"({_q(k.lower())}, {_q(v)})" for k, v in table_.items()) + ")"


_SURFACES_SQL = "s(i, type, surface) AS (VALUES " + ", ".join(f"({i}, '{t}', {_q(x)})" for i, (t, x) in enumerate(SURFACES)) + ")"
_MONTH_SQL = "(SELECT min(m) FROM (VALUES " + ", ".join(f"('{m}')" for m in V.MONTHS) + ") t(m) WHERE contains(lower(surface), lower(left(m, 3))))"


@query("generalize_types", f"""WITH {_SURFACES_SQL}, {_pairs("e", V.EMPLOYERS)}, {_pairs("o", V.OCCUPATIONS)},
g AS (SELECT c_custkey, type, surface, CASE type WHEN 'EMPLOYER' THEN coalesce((SELECT v FROM e WHERE k = lower(surface)), 'a company') WHEN 'OCCUPATION' THEN coalesce((SELECT v FROM o WHERE k = lower(surface)), 'a professional')
  WHEN 'NATIONALITY' THEN CASE WHEN lower(surface) = 'singaporean' THEN 'local' ELSE 'foreign' END WHEN 'SWIFT' THEN CASE WHEN substr(surface, 5, 2) = 'SG' THEN 'a local bank' ELSE 'a foreign bank' END
  WHEN 'DATE' THEN coalesce({_MONTH_SQL}, '[DATE]') WHEN 'DOB' THEN coalesce(nullif(regexp_extract(surface, '[0-9]{{4}}', 0), ''), {_MONTH_SQL}, '[DATE]') ELSE '[' || type || ']' END AS v
FROM customer JOIN s ON i = c_custkey % {len(SURFACES)})
SELECT c_custkey, type, surface, CASE WHEN type IN ('DATE', 'DOB', 'NATIONALITY') AND surface = lower(surface) THEN lower(v) ELSE v END AS coarse FROM g""")
def generalize_types(spark, sf_dir):
    """The coarser value of employers, occupations, nationalities, banks, dates and of a type that has none."""
    known = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(SURFACES)], "i long, type string, surface string")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(SURFACES)).alias("i")).join(F.broadcast(known), "i")
    return rows.select("c_custkey", "type", "surface", render.generalize(F.col("type"), F.col("surface")).alias("coarse"))


#: Types and surfaces whose surrogates are drawn; the surface's form decides parts of them.
DRAWN = [("EMAIL", "Some.One@mail.com"), ("EMAIL", "someone at mail dot com"), ("DATE", "3 May"), ("DOB", "3 May 1990"), ("DOB", "3 may 1990"), ("ADDRESS", "Blk 5"), ("LOCATION", "Here"), ("EMPLOYER", "there"), ("HEALTH", "Flu"), ("OTP", "123456"), ("SWIFT", "X")]


def _n(k: int) -> str:
    return f"('0x' || substr(mac, {k + 1}, 7))::BIGINT"


def _pick(pool: list[str], k: int) -> str:
    return "[" + ", ".join(map(_q, pool)) + f"][{_n(k)} % {len(pool)} + 1]"


_GIVEN, _SURNAME = _pick(V.SURROGATE_GIVEN, 7), _pick(V.SURROGATE_SURNAMES, 0)
_DAY = f"({_n(14)} % 28 + 1) || ' ' || {_pick(V.MONTHS, 21)}"


@query("surrogate_types", f"""WITH d(i, type, surface) AS (VALUES {", ".join(f"({i}, '{t}', {_q(x)})" for i, (t, x) in enumerate(DRAWN))}),
m AS (SELECT c_custkey, type, surface, {sql_hmac("type || '|' || c_name")} AS mac FROM customer JOIN d ON i = c_custkey % {len(DRAWN)} WHERE type <> 'OTP'),
r AS (SELECT *, CASE type WHEN 'EMAIL' THEN CASE WHEN surface LIKE '% at %' THEN lower({_GIVEN}) || ' dot ' || lower({_SURNAME}) || ' at mail dot example' ELSE lower({_GIVEN} || '.' || {_SURNAME}) || '@mail.example' END
  WHEN 'DATE' THEN {_DAY} WHEN 'DOB' THEN {_DAY} || ' ' || ({_n(28)} % 56 + 1950) WHEN 'ADDRESS' THEN 'Blk ' || ({_n(42)} % 999 + 1) || ' ' || {_pick(list(V.TOWNS), 35)} || ' Street ' || ({_n(49)} % 99 + 1)
  WHEN 'LOCATION' THEN {_pick(list(V.TOWNS), 0)} WHEN 'EMPLOYER' THEN {_pick(list(V.EMPLOYERS), 0)} WHEN 'HEALTH' THEN {_pick(V.LEXICONS["HEALTH"], 0)} ELSE '[REDACTED]' END AS v FROM m)
SELECT c_custkey, type, CASE WHEN surface = lower(surface) AND type <> 'SWIFT' THEN lower(v) ELSE v END AS surrogate FROM r""")
def surrogate_types(spark, sf_dir):
    """Surrogates of addresses, dates, places, employers and illnesses, drawn by a keyed hash in the form of the original."""
    known = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(DRAWN)], "i long, type string, surface string").where("type <> 'OTP'")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % len(DRAWN)).alias("i")).join(F.broadcast(known), "i")
    mac = keyed.hmac_sha256(SECRET, F.concat_ws("|", "type", "c_name"))
    drawn = rows.withColumn("mac", mac).withColumn("surrogate", render.surrogate(F.col("type"), F.col("surface"), F.col("mac")))
    return drawn.select("c_custkey", "type", "surrogate")


@query("carried_spans", CALLS + """ SELECT id, 15 AS "start", 16 + len(person)::INT AS "end", 'PERSON' AS type FROM x
UNION ALL SELECT id, 25 + len(person)::INT, 25 + len(person)::INT + len(account)::INT, 'ACCOUNT_NO' FROM x WHERE id % 3 > 0""")
def carried_spans(spark, sf_dir):
    """A name and an account number laid over another transcript of the call, in which words differ and some accounts are missing."""
    calls = tr.derived_calls(spark, sf_dir)
    ref = F.concat(F.lit("my name is "), "person", F.lit(". account "), "account")
    heard = F.when(F.col("id") % 3 > 0, F.col("account")).otherwise("")
    hyp = F.concat(F.lit("uh my name was "), "person", F.lit(". account "), heard)
    name, start = F.length("person"), F.length("person") + 21
    marks = F.array(F.struct(F.lit(11).alias("start"), (name + 11).alias("end"), F.lit("PERSON").alias("type")), F.struct(start.alias("start"), (start + F.length("account")).alias("end"), F.lit("ACCOUNT_NO").alias("type")))
    return spans.carried_over(calls.select("id", ref.alias("ref"), hyp.alias("hyp"), marks.alias("spans")))
