"""Queries over what detection did: quality, review, re-identification, release, keys and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import keyed
from spanloom.functions import values as V
from spanloom.functions.durable import durable, new_path
from spanloom.operators import access, decisions, metrics, ngrams, policy, render, spans
from spanloom.plans.analytics import _LEVEL, GOLD, scored
from spanloom.plans.calls import _ACTIONS_SQL, _TOWN_CASE, CALLS, SECRET, SPANS_SQL, line_spans, sql_hmac, table
from spanloom.plans.registry import query
from spanloom.sources import transcripts as tr

#: Gold spans of the derived calls (names and accounts), and found ones: of every three calls one has none, one shifted ones.
GOLD_FOUND = CALLS + """, g AS (SELECT id, strpos(text, 'my name is ')::INT + 10 AS a, strpos(text, 'my name is ')::INT + 10 + len(person)::INT AS z, text FROM x
  UNION ALL SELECT id, strpos(text, t5 || chr(10) || t6)::INT - 1, strpos(text, t5 || chr(10) || t6)::INT - 1 + len(account)::INT, text FROM x),
f AS (SELECT id, CASE id % 3 WHEN 1 THEN a ELSE a + 3 END AS a, CASE id % 3 WHEN 1 THEN z ELSE z + 3 END AS z FROM g WHERE id % 3 <> 0)"""


def gold_and_found(spark, sf_dir):
    calls = tr.derived_calls(spark, sf_dir)
    text = F.concat_ws("\n", *[f"t{i}" for i in range(9)]).alias("text")
    own = durable(calls.select("id", text, "person", "account", "t5", "t6"), "own")  # read for each measure, and once made
    texts = own.select("id", "text")
    name = F.locate("my name is ", "text") + 10
    account = F.expr("position(concat(t5, '\n', t6), text)") - 1
    both = F.array(F.struct(name.alias("start"), (name + F.length("person")).alias("end")), F.struct(account.alias("start"), (account + F.length("account")).alias("end")))
    gold = own.select("id", F.explode(both).alias("x")).select("id", "x.start", "x.end")
    shift = F.when(F.col("id") % 3 == 1, 0).otherwise(3)
    return texts, gold, gold.where("id % 3 <> 0").select("id", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))


@query("span_summary", GOLD_FOUND + """, w AS (SELECT id, unnest(range(1, len(ws) + 1)) AS k, ws FROM (SELECT id, regexp_extract_all(text, '\\S+') AS ws FROM x)),
t AS (SELECT id, (list_sum(list_transform(ws[1:k - 1], lambda s: len(s) + 1)))::INT AS p, len(ws[k])::INT AS n FROM w), u AS (SELECT id, coalesce(p, 0) AS a, coalesce(p, 0) + n AS z FROM t),
m AS (SELECT EXISTS (SELECT 1 FROM g WHERE g.id = u.id AND u.a < g.z AND g.a < u.z) AS ing, EXISTS (SELECT 1 FROM f WHERE f.id = u.id AND u.a < f.z AND f.a < u.z) AS inf FROM u),
b AS (SELECT sum(z - a) AS gold, sum(CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN z - a ELSE z - a - 3 END) AS hidden, sum(CASE WHEN id % 3 = 0 THEN 0 ELSE z - a END) AS found, count_if(id % 3 <> 0) AS n FROM g)
SELECT 1.0::DOUBLE AS precision, round((gold - hidden) / gold, 4) AS char_leakage, round((found - hidden) / ((SELECT sum(len(text)) FROM x) - gold), 4) AS over_redaction,
  (SELECT round(2 * count_if(ing AND inf) / (2 * count_if(ing AND inf) + count_if(ing <> inf)), 4) FROM m) AS token_f1 FROM b""")
def span_summary(spark, sf_dir):
    """Precision, readable gold characters, hidden other ones, and the F1 of words."""
    texts, gold, found = gold_and_found(spark, sf_dir)
    return metrics.summary(metrics.span_scores(gold, found, texts), texts.select("id", F.length("text").alias("n")))


@query("redaction_grade", CALLS + """ SELECT 'PERSON' AS type, count_if(id % 3 = 0) AS hidden, count_if(id % 3 = 1) AS partly, count_if(id % 3 = 2) AS released FROM x""")
def redaction_grade(spark, sf_dir):
    """Names by how much of them a rendered line still shows."""
    calls = tr.derived_calls(spark, sf_dir)
    shown = F.when(F.col("id") % 3 == 0, "i am [REDACTED].").when(F.col("id") % 3 == 1, F.concat(F.lit("i am "), F.element_at(F.split("person", " "), -1), F.lit("?"))).otherwise(F.concat(F.lit("i am "), F.upper("person"), F.lit("!")))
    return metrics.redaction_grade(calls.select("id", F.lit("PERSON").alias("type"), F.col("person").alias("surface")), calls.select("id", shown.alias("text")))


@query("review_effect", f"WITH {GOLD} SELECT count(DISTINCT CASE WHEN id % 4 = 0 THEN id END) AS calls_held, round(sum(CASE WHEN hit THEN harm ELSE 0 END) / sum(harm), 4) AS recall, round(sum(CASE WHEN hit OR id % 4 = 0 THEN harm ELSE 0 END) / sum(harm), 4) AS recall_after, count_if(NOT hit AND id % 4 <> 0) AS leaks_left FROM s")
def review_effect(spark, sf_dir):
    """What holding some calls for a person changes."""
    every = scored(spark, sf_dir)
    return metrics.review_effect(every, every.where("id % 4 = 0").select("id"))


_PEOPLE = "p AS (SELECT c_custkey AS person, lower(n_name) AS nation, lower(c_mktsegment) AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def people(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("person"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))


@query("linkage_log", f"""WITH {_PEOPLE}, l AS (SELECT DISTINCT o_custkey AS person, o_orderpriority AS band FROM orders), q AS (SELECT person AS id, nation, band FROM p JOIN (SELECT person, min(band) AS band FROM l GROUP BY person) USING (person))
SELECT q.id, count(*) AS candidates, min(p.person) AS first FROM q JOIN p ON p.nation = q.nation JOIN l ON l.person = p.person AND l.band = q.band GROUP BY q.id""")
def linkage_log(spark, sf_dir):
    """Customers of the nation that a text names who placed an order of the priority that the log tells."""
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("band"))
    every = people(spark, sf_dir)
    texts = every.join(log.groupBy("person").agg(F.min("band").alias("band")), "person").select(F.col("person").alias("id"), F.concat(F.lit("he is from "), "nation", F.lit(".")).alias("text"), "band")
    return ngrams.linkage_with_log(texts, every, log, ["nation"], ["band"])


@query("reid_rate", f"""WITH {_PEOPLE}, c AS (SELECT person, count(*) OVER (PARTITION BY nation, segment) AS n FROM p)
SELECT count(*) AS texts, round(avg(CASE WHEN n = 1 AND person % 6 <> 0 THEN 1 ELSE 0 END), 4) AS unique_and_right, round(avg(CASE WHEN person % 6 <> 0 THEN 1 ELSE 0 END), 4) AS truth_in_set,
  (SELECT list_sort(list(n))[count(*)::BIGINT // 2 + 1] FROM c WHERE person % 6 <> 0) AS median_candidates FROM c""")
def reid_rate(spark, sf_dir):
    """How many people a text about them gives away; every sixth text says nothing."""
    every = people(spark, sf_dir)
    texts = every.select(F.col("person").alias("id"), F.when(F.col("person") % 6 == 0, "nothing to see").otherwise(F.concat_ws(" ", "nation", "segment")).alias("text"))
    found = ngrams.linkage(texts, every, ["nation", "segment"]).withColumn("holds", F.lit(True))  # each says its person's own values
    return ngrams.reidentified(found, texts)


@query("direct_leaks", CALLS + " SELECT id, (1 + (id % 2 = 0)::INT)::BIGINT AS leaks FROM x")
def direct_leaks(spark, sf_dir):
    """A caller's own identifiers that a text still shows, however they are set."""
    calls = tr.derived_calls(spark, sf_dir)
    texts = calls.select("id", F.concat_ws(" / ", F.upper("person"), F.when(F.col("id") % 2 == 0, F.regexp_replace("account", "-", " ")).otherwise("***")).alias("text"))
    values = calls.select("id", F.explode(F.array("person", "account")).alias("value"))
    return ngrams.direct_leaks(texts, values)


_TURN_TEXTS = " || '\",\"' || ".join(f"t{i}" for i in range(9))
_LINES = CALLS + f""", g AS (SELECT *, CASE town {_TOWN_CASE} ELSE 'Singapore' END AS region FROM x WHERE id % 4 <> 0), e AS (SELECT row_number() OVER (ORDER BY id) - 1 AS p, '{{"id":' || id || ',"utterances":["' || {_TURN_TEXTS} || '"]}}' AS v, id, count(*) OVER (PARTITION BY region) AS k FROM g),
l0 AS (SELECT p, sha256(unhex('00') || encode(v)) AS h FROM e), """ + ", ".join(f"l{i + 1} AS ({_LEVEL.format(i)})" for i in range(22))


@query("export_manifest", _LINES + " SELECT (SELECT count(*) FROM e) AS calls, (SELECT count(*) FROM e WHERE k < 2000) AS gated, (SELECT min(k) FROM e) AS smallest_k, h AS sha256 FROM l22")
def export_manifest(spark, sf_dir):
    """The public export of whole calls as JSON lines with its manifest, held calls left out, classes by the region that is shown."""
    calls = tr.derived_calls(spark, sf_dir).where("id % 4 <> 0")
    pieces = calls.select("id", F.array(*[f"t{i}" for i in range(9)]).alias("utterances"))
    gates = decisions.k_gate(calls.select("id", render.generalize(F.lit("LOCATION"), F.col("town")).alias("qid")), 2000)
    done = tr.export_lines(pieces, gates, new_path(spark, "export"), policy.version())
    return spark.createDataFrame([(done["calls"], done["gated"], done["smallest_k"], done["sha256"])], "calls long, gated long, smallest_k long, sha256 string")


@query("copies_opened", CALLS + " SELECT tier, count(*) AS copies, count_if(id % 5 <> 0 AND tier = 'GREEN') AS opened, count_if(id % 5 <> 0 AND tier = 'GREEN') AS right_text FROM x, (VALUES ('RED'), ('GREEN')) v(tier) GROUP BY tier")
def copies_opened(spark, sf_dir):
    """Sealed copies with keys of their own, of which a public holder opens those whose keys weren't erased."""
    calls = tr.derived_calls(spark, sf_dir)
    copies = calls.select("id", F.explode(F.array(F.lit("RED"), F.lit("GREEN"))).alias("tier"), F.concat_ws("\n", *[f"t{i}" for i in range(9)]).alias("text"))
    own = keyed.hmac_sha256(SECRET, F.concat_ws("|", F.col("id").cast("string"), "tier"))
    keys = copies.select("id", "tier", F.concat(F.lit("tier:"), "tier").alias("policy"), F.unhex(own).alias("key"))
    path = new_path(spark, "sealed")
    access.write_copies(copies, keys, SECRET, path)
    kept = spark.read.parquet(f"{path}/keys").where("id % 5 <> 0")
    opened = access.open_copies(spark.read.parquet(f"{path}/copies"), kept, SECRET, F.col("policy") == "tier:GREEN")
    digest = F.unhex(F.sha2("text", 256))  # texts are compared by it: it is all that moves
    both = copies.select("id", "tier", digest.alias("sha")).join(opened.select("id", "tier", digest.alias("opened")), ["id", "tier"], "left")
    return both.groupBy("tier").agg(F.count("*").alias("copies"), F.count("opened").alias("opened"), F.count_if(F.col("opened") == F.col("sha")).alias("right_text"))


@query("key_issuance", "SELECT CASE WHEN event_id % 7 = 0 THEN 'bad mac' WHEN event_id % 5 = 0 THEN 'stale' WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'no reason' ELSE 'issued' END AS verdict, count(*) AS n FROM events GROUP BY 1")
def key_issuance(spark, sf_dir):
    """Requests for keys with forged MACs, old times and missing reasons, by what the authority answers."""
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    event = F.col("event_id")
    asked = table(spark, sf_dir, "events").select(
        event.cast("string").alias("who"), F.array(F.lit("tier:RED"), F.lit("agent:a")).alias("attributes"), F.when(event % 5 == 0, now - F.expr("interval 61 seconds")).otherwise(now + F.expr("interval 60 seconds")).alias("at"),
        (event % 2 == 0).alias("breakglass"), F.when(event % 3 == 0, "a court order of 3 May").otherwise("  short   reason ").alias("reason"), "event_id",
    )
    message = F.concat_ws("|", "who", F.array_join("attributes", ","), F.col("at").cast("string"), F.col("breakglass").cast("string"), "reason")
    mac = F.when(event % 7 == 0, F.lit("00")).otherwise(keyed.hmac_sha256(SECRET, message))
    return access.issue_keys(asked.withColumn("mac", mac), now, SECRET).groupBy("verdict").agg(F.count("*").alias("n"))


@query("attack_verdict", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nothing to try' WHEN 1 THEN 'held' WHEN 2 THEN 'own copies only' ELSE 'breach' END AS verdict FROM events")
def attack_verdict(spark, sf_dir):
    """What runs of stolen keys show."""
    k = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", access.attack_verdict(F.when(k >= 2, k).otherwise(0), F.when(k > 0, 5).otherwise(0), F.lit(2)).alias("verdict"))


@query("plaintext_hits", "SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 3 = 1 THEN 'root' ELSE 'dek' END AS kind, 1::BIGINT AS n FROM events WHERE event_id % 3 > 0")
def plaintext_hits(spark, sf_dir):
    """Stolen files in which a key stands readable, raw or as hex."""
    key = F.col("event_id") % 3
    content = F.concat(F.lit("data "), F.when(key == 1, "rootsecret").when(key == 2, F.lower(F.hex(F.lit("dataencryptionkey")))).otherwise("nothing"), F.lit(" end")).cast("binary")
    needles = spark.createDataFrame([("root", "rootsecret"), ("dek", "dataencryptionkey")], "kind string, value string")
    return access.plaintext_hits(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), content.alias("content")), needles)


@query("policy_variants", f"""WITH {SPANS_SQL}, {_ACTIONS_SQL}, v(variant) AS (VALUES ('all-suppress'), ('all-pseudonym'), ('all-surrogate'), ('keep-quasi'))
SELECT variant, CASE WHEN tier <> 'GREEN' THEN action WHEN variant = 'keep-quasi' THEN CASE WHEN class IN ('QUASI_ID', 'SENSITIVE_ATTR') THEN 'keep' ELSE action END ELSE substr(variant, 5) END AS act, tier, count(*) AS n FROM s JOIN a USING (type), v GROUP BY ALL""")
def policy_variants(spark, sf_dir):
    """How many spans each action takes under other policies."""
    every = [policy.overridden(policy.actions(spark), v).withColumn("variant", F.lit(v)) for v in ("all-suppress", "all-pseudonym", "all-surrogate", "keep-quasi")]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    met = line_spans(spark, sf_dir).select("type").join(F.broadcast(out), "type")
    return met.groupBy("variant", F.col("action").alias("act"), "tier").agg(F.count("*").alias("n"))


@query("review_release", CALLS + " SELECT state, policy, count(*) AS n FROM (SELECT CASE WHEN tier = 'GREEN' AND held THEN CASE WHEN id % 8 = 0 THEN 'approved' ELSE 'held' END ELSE 'open' END AS state, CASE WHEN tier = 'GREEN' AND held AND id % 8 <> 0 THEN 'tier:RED' ELSE 'tier:' || tier END AS policy FROM (SELECT id, id % 4 = 0 AS held, tier FROM x, (VALUES ('RED'), ('GREEN')) v(tier))) GROUP BY ALL")
def review_release(spark, sf_dir):
    """Held public copies, of which a reviewer approves half."""
    held = (F.col("id") % 4 == 0) & (F.col("tier") == "GREEN")
    copies = tr.derived_calls(spark, sf_dir).select("id", F.explode(F.array(F.lit("RED"), F.lit("GREEN"))).alias("tier"))
    copies = copies.select("id", "tier", F.when(held, "held").otherwise("open").alias("state"), F.when(held, "tier:RED").otherwise(F.concat(F.lit("tier:"), "tier")).alias("policy"))
    done = decisions.release_reviewed(copies, copies.where("id % 8 = 0").select("id"))
    return done.groupBy("state", "policy").agg(F.count("*").alias("n"))


@query("release_risk", "WITH a(controls, motivation, p) AS (VALUES " + ", ".join(f"('{c}', '{m}', {p})" for c, m, p in V.ATTEMPT) + "), r AS (SELECT avg(toxic) AS rate FROM labels) SELECT controls, motivation, round(rate * p, 6) AS risk FROM a, r")
def release_risk(spark, sf_dir):
    """A measured rate times the probability of an attempt."""
    return decisions.release_risk(table(spark, sf_dir, "labels").agg(F.avg("toxic").alias("rate")), spark.createDataFrame(V.ATTEMPT, "controls string, motivation string, p double"))


@query("bleep_times", CALLS + " SELECT id, 1.0::DOUBLE AS t0, 3.0::DOUBLE AS t1, ['OTP', 'PERSON'] AS types FROM x UNION ALL SELECT id, 4.0, 5.0, ['OTP'] FROM x WHERE id % 2 = 0")
def bleep_times(spark, sf_dir):
    """The times of the words that spans touch, neighbours as one."""
    ids = tr.derived_calls(spark, sf_dir).select("id")
    words = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select("id", (F.col("k") * 6).alias("start"), (F.col("k") * 6 + 5).alias("end"), F.col("k").cast("double").alias("t0"), (F.col("k") + 1.0).cast("double").alias("t1"))
    hit = ids.select("id", F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(t).alias("type")) for s, e, t in ((8, 9, "PERSON"), (12, 14, "OTP"), (24, 25, "OTP"))])).alias("x")).select("id", "x.*")
    return spans.word_spans(words, hit.where("start < 20 or id % 2 = 0"))


@query("word_categories", "SELECT CASE WHEN w ~ '^[0-9]+$' THEN 'figures' WHEN w IN ('the', 'and', 'of') THEN 'function' ELSE 'other' END AS category, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1")
def word_categories(spark, sf_dir):
    """Words of all documents by the first category that fits."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    return metrics.word_categories(words, [("figures", "^[0-9]+$"), ("function", "^(?:the|and|of)$")])


@query("shape_kept", CALLS + " SELECT id, id % 2 = 0 AS kept FROM x")
def shape_kept(spark, sf_dir):
    """Whether a replacement has the digits in the same places."""
    new = F.when(F.col("id") % 2 == 0, F.regexp_replace("account", "[0-9]", "7")).otherwise("<ACCOUNT_NO_1>")
    return tr.derived_calls(spark, sf_dir).select("id", metrics.shape_kept(F.col("account"), new).alias("kept"))


@query("deploy_rule", "SELECT l_orderkey, l_linenumber, l_tax < l_discount AND l_tax <= 0.03 + 0.01 AS deploy FROM lineitem")
def deploy_rule(spark, sf_dir):
    """Whether a model trained on released text may go out."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", metrics.deployable(F.col("l_discount"), F.col("l_tax"), F.lit(0.03)).alias("deploy"))


@query("dataset_summary", CALLS + " SELECT count(*) AS calls, count(*) * 9 AS turns, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words, count(*) * 2 AS spans, 2::BIGINT AS types FROM x")
def dataset_summary(spark, sf_dir):
    """The size of a corpus."""
    calls = tr.derived_calls(spark, sf_dir)
    marked = calls.select(F.explode(F.array(F.lit("PERSON"), F.lit("OTP"))).alias("type"))
    return metrics.dataset_summary(calls, tr.derived_turns(calls), marked)


@query("nbest_weight", """WITH h AS (SELECT l_orderkey AS id, CAST(l_linenumber AS VARCHAR) AS hyp, l_quantity AS lp, round(l_discount * 100) AS lm, (l_partkey % 7)::BIGINT AS errors FROM lineitem), w(weight) AS (VALUES (0.0::DOUBLE), (0.5), (2.0)),
c AS (SELECT weight, id, errors FROM h, w QUALIFY row_number() OVER (PARTITION BY weight, id ORDER BY lp + weight * lm DESC, hyp, errors) = 1)
SELECT weight, sum(errors)::BIGINT AS errors, (SELECT sum(e)::BIGINT FROM (SELECT min(errors) AS e FROM h GROUP BY id)) AS oracle FROM c GROUP BY weight ORDER BY errors, weight LIMIT 1""")
def nbest_weight(spark, sf_dir):
    """The weight of the language model with the fewest errors, and what the best choice of every list would leave."""
    line = table(spark, sf_dir, "lineitem")
    hyps = line.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("string").alias("hyp"), F.col("l_quantity").alias("lp"), F.round(F.col("l_discount") * 100).alias("lm"), (F.col("l_partkey") % 7).alias("errors"))
    return ngrams.best_weight(hyps, [0.0, 0.5, 2.0]).join(F.broadcast(ngrams.oracle_errors(hyps).withColumnRenamed("errors", "oracle")))


@query("content_digest", "SELECT conv_id, turn, sha256('{\"role\":\"' || role || '\",\"n\":' || len(text) || '}') AS digest FROM conversations")
def content_digest(spark, sf_dir):
    """Digests of released content as JSON."""
    from spanloom.operators.audit import content_digest as digest

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", digest(F.struct("role", F.length("text").alias("n"))).alias("digest"))


@query("issued_subkeys", f"SELECT n_nationkey, {sql_hmac('n_name')} AS tag FROM nation")
def issued_subkeys(spark, sf_dir):
    """Keyed tags of names: what stands for a signature."""
    return table(spark, sf_dir, "nation").select("n_nationkey", keyed.hmac_sha256(SECRET, F.col("n_name")).alias("tag"))
