"""Queries over numbers, logs and models: checks, spoken forms, audit, evaluation, language models."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import checks, keyed, spoken
from spanloom.functions.ranking import ranked
from spanloom.operators import audit, metrics, ngrams
from spanloom.plans.calls import DOCS, LUHN_SQL, SECRET, documents, sql_hmac, table
from spanloom.plans.registry import query
from spanloom.sources import transcripts as tr

_W = [2, 7, 6, 5, 4, 3, 2]
_NRIC = "lpad(CAST(o_orderkey * 7919 % 10000000 AS STRING), 7, '0')"
_SUM = " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(_W))


@query("nric_checksum", f"""WITH n AS (SELECT o_orderkey, substr('STFG', (o_orderkey % 4 + 1)::INT, 1) AS p, {_NRIC} AS d, substr('ABCDEFGHIJKLMNPQRTUWXZ', (o_orderkey % 22 + 1)::INT, 1) AS l FROM orders),
s AS (SELECT *, ({_SUM} + CASE WHEN p IN ('T', 'G') THEN 4 ELSE 0 END) % 11 AS r FROM n)
SELECT o_orderkey, p || d || l AS nric, CASE WHEN p IN ('S', 'T') THEN substr('JZIHGFEDCBA', r + 1, 1) ELSE substr('XWUTRQPNMLK', r + 1, 1) END = l AS valid FROM s""")
def nric_checksum(spark, sf_dir):
    """Identity numbers made of order keys, and whether their letter is right."""
    pick = lambda letters, n: F.substring(F.lit(letters), (F.col("o_orderkey") % n + 1).cast("int"), F.lit(1))
    nric = F.concat(pick("STFG", 4), F.lpad((F.col("o_orderkey") * 7919 % 10_000_000).cast("string"), 7, "0"), pick("ABCDEFGHIJKLMNPQRTUWXZ", 22))
    return table(spark, sf_dir, "orders").select("o_orderkey", nric.alias("nric")).withColumn("valid", checks.nric_valid(F.col("nric")))


@query("luhn_digits", f"WITH d AS (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 829283 % 100000000000000 AS STRING), 14, '0') || CAST(o_orderkey % 10 AS STRING) AS n FROM orders) SELECT o_orderkey, {LUHN_SQL} AS valid FROM d")
def luhn_digits(spark, sf_dir):
    """Card numbers made of order keys, and whether their check digit is right."""
    card = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 829283 % 100_000_000_000_000).cast("string"), 14, "0"), (F.col("o_orderkey") % 10).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.luhn_valid(card).alias("valid"))


@query("iban_mod97", """WITH b AS (SELECT c_custkey, 'NWBK' || lpad(CAST(c_custkey * 104729 % 100000000000000 AS STRING), 14, '0') AS rest, lpad(CAST(c_custkey % 97 + 2 AS STRING), 2, '0') AS chk FROM customer),
m AS (SELECT *, CAST('23321120' || substr(rest, 5) || '1611' || chk AS HUGEINT) % 97 AS r, 98 - CAST('23321120' || substr(rest, 5) || '161100' AS HUGEINT) % 97 AS c FROM b)
SELECT c_custkey, r = 1 AS valid, lpad(CAST(c AS STRING), 2, '0') AS check_digits FROM m""")
def iban_mod97(spark, sf_dir):
    """Account numbers made of customer keys: validity, and the right check digits."""
    rest = F.concat(F.lit("NWBK"), F.lpad((F.col("c_custkey") * 104729 % 100_000_000_000_000).cast("string"), 14, "0"))
    iban = F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 97 + 2).cast("string"), 2, "0"), rest)
    return table(spark, sf_dir, "customer").select("c_custkey", checks.iban_valid(iban).alias("valid"), checks.iban_check(F.lit("GB"), rest).alias("check_digits"))


_TENS = "['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"
_ONES = "['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine']"


@query("number_words_value", "SELECT p_partkey, (p_partkey % 8 + 2) * 10000 + (p_partkey % 9 + 1) * 100 + p_partkey % 8 * 10 + 20 AS value, (p_partkey % 8 + 2) * 10 + 1900 AS year FROM part")
def number_words_value(spark, sf_dir):
    """Spoken amounts and years as numbers."""
    tens, ones = F.array(*[F.lit(x) for x in ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")]), F.array(*[F.lit(x) for x in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")])
    t, o = F.get(tens, (F.col("p_partkey") % 8).cast("int")), F.get(ones, (F.col("p_partkey") % 9).cast("int"))
    amount = F.concat_ws(" ", t, F.lit("thousand"), o, F.lit("hundred and"), t)
    return table(spark, sf_dir, "part").select("p_partkey", spoken.number_words(amount).cast("long").alias("value"), spoken.number_words(F.concat(F.lit("nineteen "), t)).cast("long").alias("year"))


_DIGIT = "['zero', 'yi', 'dua', 'three', 'si', 'lima', 'six', 'qi', 'lapan', 'jiu']"


@query("spoken_digits", "SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 100000 AS VARCHAR), 5, '0') || repeat(CAST(p_partkey % 10 AS VARCHAR), 2) AS digits FROM part")
def spoken_digits(spark, sf_dir):
    """Numbers read out in three languages, with a doubled digit."""
    words = F.array(*[F.lit(x) for x in ("zero", "yi", "dua", "three", "si", "lima", "six", "qi", "lapan", "jiu")])
    number = F.lpad((F.col("p_partkey") * 7919 % 100_000).cast("string"), 5, "0")
    said = F.array_join(F.transform(F.filter(F.split(number, ""), lambda c: c != ""), lambda c: F.get(words, c.cast("int"))), " uh ")
    text = F.concat(said, F.lit(" double "), F.get(words, (F.col("p_partkey") % 10).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", spoken.digit_tokens(text).alias("digits"))


@query("spoken_normalize", "SELECT p_partkey, 'otp ' || lpad(CAST(p_partkey * 7919 % 100000 AS VARCHAR), 5, '0') || ' thanks' AS norm, 4 AS first_start FROM part")
def spoken_normalize(spark, sf_dir):
    """A read-out inside a sentence, rewritten with a map back to its words."""
    words = F.array(*[F.lit(x) for x in ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")])
    number = F.lpad((F.col("p_partkey") * 7919 % 100_000).cast("string"), 5, "0")
    said = F.array_join(F.transform(F.filter(F.split(number, ""), lambda c: c != ""), lambda c: F.get(words, c.cast("int"))), " ")
    mapped = spoken.normalize_with_map(F.concat(F.lit("otp "), said, F.lit(" thanks")))
    return table(spark, sf_dir, "part").select("p_partkey", mapped.alias("m")).select("p_partkey", "m.norm", F.get(F.get("m.changed", F.lit(0)), F.lit(0)).alias("first_start"))


@query("spoken_email", "SELECT c_custkey, 'user' || c_custkey || '.x@mail.com' AS email, 'user' || c_custkey || '.x@mail.com' AS key FROM customer")
def spoken_email(spark, sf_dir):
    """Spoken addresses as written ones, with their keys."""
    said = F.concat(F.lit("User"), "c_custkey", F.lit(" dot x at mail dot com"))
    out = spoken.spoken_email(said)
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(out).alias("email"), spoken.canonical_key(out).alias("key"))


@query("strip_fillers", "SELECT conv_id, turn, regexp_replace(text, '(?i)\\b(?:uh|um|erm)\\b ?', '', 'g') AS text FROM conversations")
def strip_fillers(spark, sf_dir):
    """Turns without fillers."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", spoken.strip_fillers(F.col("text")).alias("text"))


@query("subkey_hmac", f"SELECT event_id, {sql_hmac('event_type')} AS mac FROM events")
def subkey_hmac(spark, sf_dir):
    """Keyed hashes of event types."""
    return table(spark, sf_dir, "events").select("event_id", keyed.hmac_sha256(SECRET, F.col("event_type")).alias("mac"))


ENTRY = "CAST(event_id AS VARCHAR) || '|' || event_type || '|' || CAST(user_id AS VARCHAR)"


def entries(spark, sf_dir):
    entry = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), entry.alias("entry"), "event_type", "user_id")


@query("merkle_leaf", f"SELECT event_id AS seq, sha256(unhex('00') || encode({ENTRY})) AS hash FROM events")
def merkle_leaf(spark, sf_dir):
    """The leaf hash of every audit entry."""
    return entries(spark, sf_dir).select("seq", audit.leaf_hash(F.col("entry")).alias("hash"))


_LEVEL = "SELECT p // 2 AS p, CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(min_by(h, p)) || unhex(max_by(h, p))) ELSE min(h) END AS h FROM l{} GROUP BY p // 2"


@query("merkle_root", f"WITH l0 AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS p, sha256(unhex('00') || encode({ENTRY})) AS h FROM events), " + ", ".join(f"l{i + 1} AS ({_LEVEL.format(i)})" for i in range(22)) + " SELECT h AS root FROM l22")
def merkle_root(spark, sf_dir):
    """The root over all audit entries."""
    rows = ranked(entries(spark, sf_dir), ["seq"])
    return audit.merkle_root(rows.select("pos", audit.leaf_hash(F.col("entry")).alias("hash")))


@query("audit_tamper_first_bad", "SELECT min(event_id) AS first_bad FROM events WHERE event_id % 1000 = 777")
def audit_tamper_first_bad(spark, sf_dir):
    """The first entry whose content was changed after it was hashed."""
    rows = entries(spark, sf_dir).withColumn("hash", audit.leaf_hash(F.col("entry")))
    changed = F.when(F.col("seq") % 1000 == 777, F.concat("entry", F.lit("!"))).otherwise(F.col("entry"))
    return audit.first_bad(rows, changed)


@query("recent_topk", f"SELECT event_id AS seq, {ENTRY} AS entry FROM events ORDER BY event_id DESC LIMIT 100")
def recent_topk(spark, sf_dir):
    """The last 100 entries."""
    return audit.recent(entries(spark, sf_dir), 100).select("seq", "entry")


@query("audit_counters", "SELECT count_if(event_type IN ('click', 'view')) AS reads, count_if(event_type NOT IN ('click', 'view')) AS others, count(DISTINCT user_id) AS users FROM events")
def audit_counters(spark, sf_dir):
    """Counters of a log by action."""
    read = F.col("event_type").isin("click", "view")
    return entries(spark, sf_dir).agg(F.count_if(read).alias("reads"), F.count_if(~read).alias("others"), F.countDistinct("user_id").alias("users"))


GOLD = """o AS (SELECT l_orderkey AS id, (l_linenumber * 40)::INT AS "start", (l_linenumber * 40 + 10 + l_partkey % 8)::INT AS "end", CASE l_linenumber % 3 WHEN 0 THEN 'OTP' WHEN 1 THEN 'PERSON' ELSE 'LOCATION' END AS type,
  CASE l_linenumber % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 1 END AS harm, l_suppkey % 5 AS key, l_partkey % 10 AS part FROM lineitem),
g AS (SELECT DISTINCT id, "start", "end", type, harm, key FROM o),
f AS (SELECT id, CASE WHEN part < 7 THEN "start" ELSE "start" + 2 END AS a, "end" AS z, CASE WHEN part < 8 THEN type ELSE 'DATE' END AS t FROM o WHERE part < 9),
s AS (SELECT g.id, g."start", g."end", g.type, g.harm, g.key, count(f.id) > 0 AS hit, coalesce(bool_or(f.a = g."start" AND f.z = g."end" AND f.t = g.type), false) AS strict, coalesce(bool_or(f.t = g.type), false) AS type_ok
  FROM g LEFT JOIN f ON f.id = g.id AND g."start" < f.z AND f.a < g."end" GROUP BY ALL)"""


def scored(spark, sf_dir):
    """Gold spans made of order lines, scored against shifted, mistyped and missing ones."""
    line, part = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 10
    kind = F.col("l_linenumber") % 3
    gold = line.select(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 40).alias("start"), (F.col("l_linenumber") * 40 + 10 + F.col("l_partkey") % 8).cast("int").alias("end"),
        F.when(kind == 0, "OTP").when(kind == 1, "PERSON").otherwise("LOCATION").alias("type"), F.when(kind == 0, 10).when(kind == 1, 5).otherwise(1).alias("harm"),
        (F.col("l_suppkey") % 5).alias("key"), part.alias("part"),
    )
    found = gold.where("part < 9").select("id", F.when(F.col("part") < 7, F.col("start")).otherwise(F.col("start") + 2).alias("start"), "end", F.when(F.col("part") < 8, F.col("type")).otherwise("DATE").alias("type"))
    return metrics.per_span(gold.drop("part"), found)


@query("harm_recall", f"WITH {GOLD} SELECT type, count(*) AS n, round(count_if(hit) / count(*), 4) AS recall, round(sum(CASE WHEN hit THEN harm ELSE 0 END) / sum(harm), 4) AS weighted_recall, round(count_if(strict) / count(*), 4) AS strict_recall, round(count_if(type_ok) / count_if(hit), 4) AS type_accuracy FROM s GROUP BY type")
def harm_recall(spark, sf_dir):
    """Recall by type, weighted by harm, strict, and the share of right types."""
    return metrics.recall(scored(spark, sf_dir), ["type"])


@query("harm_sensitivity", f"WITH {GOLD}, w(scheme, p) AS (VALUES ('flat', 0), ('linear', 1), ('square', 2)) SELECT scheme, round(sum(CASE WHEN hit THEN pow(harm, p) ELSE 0 END) / sum(pow(harm, p)), 4) AS weighted_recall FROM s, w GROUP BY scheme")
def harm_sensitivity(spark, sf_dir):
    """Weighted recall under other weightings."""
    schemes = spark.createDataFrame([("flat", 0), ("linear", 1), ("square", 2)], "scheme string, p int")
    every = scored(spark, sf_dir).join(F.broadcast(schemes)).withColumn("w", F.pow("harm", "p"))
    return metrics.recall(every, ["scheme"], "w").select("scheme", "weighted_recall")


@query("entity_recall", f"WITH {GOLD}, e AS (SELECT id, type, key, bool_and(hit) AS a FROM s GROUP BY ALL) SELECT type, count(*) AS entities, round(count_if(a) / count(*), 4) AS entity_recall FROM e GROUP BY type")
def entity_recall(spark, sf_dir):
    """Entities all of whose mentions were found."""
    return metrics.entity_recall(scored(spark, sf_dir))


@query("misses_top4_per_type", f"WITH {GOLD} SELECT type, row_number() OVER (PARTITION BY type ORDER BY id, \"start\", \"end\") AS n, id, \"start\", \"end\" FROM s WHERE NOT hit QUALIFY n <= 4")
def misses_top4_per_type(spark, sf_dir):
    """The first misses of each type."""
    return metrics.misses(scored(spark, sf_dir))


@query("confusion_pivot", "SELECT quality, count_if(toxic = 0) AS \"0\", count_if(toxic = 1) AS \"1\" FROM labels GROUP BY quality")
def confusion_pivot(spark, sf_dir):
    """Two labels against each other."""
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


_TIMES = " + ".join(f"(u >= {c})::INT" for c in metrics.POISSON_CUTS)
_BOOT = f"""WITH d AS (SELECT doc_id, r, quality AS num, toxic AS num_b, ('0x' || substr({sql_hmac("CAST(doc_id AS VARCHAR) || '|' || CAST(r // 8 AS VARCHAR)")}, (r % 8 * 7 + 1)::INT, 7))::BIGINT AS u FROM labels, range(200) x(r)),
b AS (SELECT r, num, num_b, {_TIMES} AS k FROM d), """


def boot_rows(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("num"), F.col("toxic").alias("num_b"), F.lit(1).alias("den"))


@query("bootstrap_ci_hashdraw", _BOOT + "v AS (SELECT r, sum(k * num) / sum(k) AS v FROM b GROUP BY r), o AS (SELECT list_sort(list(v)) AS v FROM v) SELECT round(v[6], 4) AS low, round(v[195], 4) AS high FROM o")
def bootstrap_ci_hashdraw(spark, sf_dir):
    """A 95% interval over 200 keyed resamples."""
    return metrics.bootstrap(boot_rows(spark, sf_dir), 200, SECRET)


@query("paired_bootstrap", _BOOT + "v AS (SELECT r, (sum(k * num_b) - sum(k * num)) / sum(k) AS g FROM b GROUP BY r) SELECT round(avg(g), 4) AS mean_gain, round(avg(CASE WHEN g <= 0 THEN 1 ELSE 0 END), 4) AS p FROM v")
def paired_bootstrap(spark, sf_dir):
    """Two arms over the same resamples."""
    return metrics.paired_bootstrap(boot_rows(spark, sf_dir).withColumnRenamed("num", "num_a"), 200, SECRET)


@query("rate_per_1000_words", r"""WITH w AS (SELECT sum(len(regexp_extract_all(text, '[^ \t\n\r]+'))) AS w FROM documents), s AS (SELECT unnest(regexp_extract_all(lower(text), '\b(?:the|and|of|la|der)\b')) AS type FROM documents)
SELECT type, count(*) AS n, round(count(*) * 1000 / (SELECT w FROM w), 4) AS per_1000 FROM s GROUP BY type ORDER BY n DESC, type LIMIT 3""")
def rate_per_1000_words(spark, sf_dir):
    """The most frequent of some words, per thousand."""
    docs = documents(spark, sf_dir)
    found = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(spoken.any_of(["the", "and", "of", "la", "der"])), F.lit(0))).alias("type"))
    return metrics.rates(found, docs.select(F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).alias("n_words")), 3)


@query("blind_sample", f"SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY mac) AS n FROM (SELECT lang, doc_id, {sql_hmac('CAST(doc_id AS VARCHAR)')} AS mac FROM documents) QUALIFY n <= 10")
def blind_sample(spark, sf_dir):
    """Ten documents per language, drawn by a keyed hash: a sampling operator."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", keyed.hmac_sha256(SECRET, F.col("doc_id").cast("string")).alias("mac"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mac"))).where("n <= 10").select("lang", "doc_id", "n")


@query("mean_sd_seeds", "SELECT l_linenumber, round(avg(l_discount), 4) AS mean, round(stddev_samp(l_discount), 4) AS sd FROM lineitem GROUP BY l_linenumber")
def mean_sd_seeds(spark, sf_dir):
    """Mean and standard deviation of repeated runs."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg("l_discount"), 4).alias("mean"), F.round(F.stddev_samp("l_discount"), 4).alias("sd"))


@query("target_table", """WITH r AS (SELECT lang, round(avg(quality), 4) AS q, round(avg(toxic), 4) AS t FROM labels JOIN documents USING (doc_id) GROUP BY lang), w AS (SELECT min(q) AS q, max(t) AS t FROM r)
SELECT 'quality' AS target, q AS value, 0.8::DOUBLE AS bound, q >= 0.8 AS met FROM w UNION ALL SELECT 'toxic', t, 0.15, t <= 0.15 FROM w UNION ALL SELECT 'latency', NULL, 1.0, NULL""")
def target_table(spark, sf_dir):
    """Targets met and not met in the worst language, and one that nobody measured."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    by_lang = rows.groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"))
    measured = by_lang.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("value")) for t in ("quality", "toxic")])).alias("x")).select("x.*")
    wanted = spark.createDataFrame([("quality", 0.8, True), ("toxic", 0.15, False), ("latency", 1.0, False)], "target string, bound double, at_least boolean")
    return metrics.targets(measured, wanted)


_TOK = f"t AS (SELECT id, unnest(range(len(w) + 1)) AS pos, unnest(list_prepend('<s>', w)) AS tok FROM (SELECT id, regexp_extract_all(lower(text), '{ngrams.TOKEN}') AS w FROM {DOCS}))"
_BI = _TOK + ", p AS (SELECT id, pos, tok AS a, lead(tok) OVER (PARTITION BY id ORDER BY pos) AS b FROM t), q AS (SELECT * FROM p WHERE b IS NOT NULL)"


@query("bigram_counts", f"WITH {_BI} SELECT a, b, count(*) AS c_ab FROM q GROUP BY a, b")
def bigram_counts(spark, sf_dir):
    """Bigrams of all documents."""
    return ngrams.pair_counts(documents(spark, sf_dir))


@query("bigram_perplexity", f"""WITH {_BI}, tr AS (SELECT * FROM q WHERE id % 5 <> 0), te AS (SELECT * FROM q WHERE id % 5 = 0), ab AS (SELECT a, b, count(*) AS c FROM tr GROUP BY a, b), ca AS (SELECT a, count(*) AS c FROM tr GROUP BY a),
cb AS (SELECT b, count(*) AS c FROM tr GROUP BY b), tot AS (SELECT sum(c) AS n, count(*) AS v FROM cb),
s AS (SELECT ln(CASE WHEN ca.c IS NULL THEN (coalesce(cb.c, 0) + 1) / (n + v) ELSE 0.7::DOUBLE * coalesce(ab.c, 0) / ca.c + 0.3::DOUBLE * (coalesce(cb.c, 0) + 1) / (n + v) END) AS logp, cb.c IS NOT NULL AS known
FROM te LEFT JOIN ab USING (a, b) LEFT JOIN ca ON ca.a = te.a LEFT JOIN cb ON cb.b = te.b, tot)
SELECT count(*) AS tokens, round(exp(-avg(logp)), 2) AS perplexity, round(avg(CASE WHEN known THEN 0 ELSE 1 END), 4) AS oov FROM s""")
def bigram_perplexity(spark, sf_dir):
    """An interpolated bigram model, trained on four fifths of the documents and scored on the rest."""
    docs = documents(spark, sf_dir)
    return ngrams.perplexity(ngrams.log_probabilities(ngrams.pair_counts(docs.where("id % 5 = 0")), ngrams.model(docs.where("id % 5 <> 0"))))


_NB = _TOK + """, l AS (SELECT t.id, tok, quality AS label FROM t JOIN labels ON doc_id = id WHERE pos > 0), tr AS (SELECT * FROM l WHERE id % 4 <> 0), te AS (SELECT id, tok FROM l WHERE id % 4 = 0),
pr AS (SELECT label, ln(count(DISTINCT id)) AS prior, count(*) AS n FROM tr GROUP BY label), v AS (SELECT count(DISTINCT tok) AS v FROM tr), c AS (SELECT label, tok, count(*) AS c FROM tr GROUP BY ALL),
s AS (SELECT te.id, pr.label, any_value(prior) + sum(ln((coalesce(c.c, 0) + 1) / (n + v))) AS score FROM te, v, pr LEFT JOIN c ON c.label = pr.label AND c.tok = te.tok GROUP BY te.id, pr.label)"""


@query("nb_quality", f"WITH {_NB} SELECT id, label FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, label) = 1")
def nb_quality(spark, sf_dir):
    """Naive Bayes for document quality."""
    toks = ngrams.tokens(documents(spark, sf_dir)).where("pos > 0")
    rows = toks.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "id")
    return ngrams.naive_bayes(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0").select("id", "tok"))


_MAC_TOK = sql_hmac("CAST(id AS VARCHAR) || '|' || tok")


@query("dp_cap_counts", f"WITH {_TOK}, d AS (SELECT DISTINCT id, tok FROM t WHERE pos > 0), c AS (SELECT id, tok FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_MAC_TOK}, tok) <= 50) SELECT tok, count(*) AS n FROM c GROUP BY tok")
def dp_cap_counts(spark, sf_dir):
    """Word counts to which no document gives more than 50 distinct words."""
    toks = ngrams.word_lists(documents(spark, sf_dir))
    return ngrams.capped_lists(toks, 50, SECRET).groupBy("tok").agg(F.count("*").alias("n"))


def noise_of(epsilon: float) -> tuple[float, float]:
    """Scale and threshold of the noisy counts: 50 words a document, half of epsilon and of a delta of 1e-5."""
    scale = 50 / (epsilon / 2)
    return scale, 1 + scale * math.log(50 / 1e-5)


def _noisy(epsilon: float) -> str:
    scale, least = noise_of(epsilon)
    return f"""u AS (SELECT tok, n, (('0x' || substr({sql_hmac('tok')}, 1, 7))::BIGINT + 0.5::DOUBLE) / 268435456 - 0.5::DOUBLE AS u FROM k),
z AS (SELECT tok, n, round(n - sign(u) * {scale}::DOUBLE * ln(1 - 2 * abs(u)), 4) AS noisy FROM u) SELECT tok, n, noisy FROM z WHERE noisy >= {least}::DOUBLE"""


@query("dp_noisy_counts", f"WITH {_TOK}, d AS (SELECT DISTINCT id, tok FROM t WHERE pos > 0), c AS (SELECT id, tok FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_MAC_TOK}, tok) <= 50), k AS (SELECT tok, count(*) AS n FROM c GROUP BY tok), {_noisy(8)}")
def dp_noisy_counts(spark, sf_dir):
    """Those counts with keyed Laplace noise and a threshold (epsilon 8, delta 1e-5, half of either for words)."""
    toks = ngrams.word_lists(documents(spark, sf_dir))
    return ngrams.laplace_counts(ngrams.capped_lists(toks, 50, SECRET), *noise_of(8), SECRET)


@query("dp_noisy_bigrams", f"WITH {_BI}, d AS (SELECT DISTINCT id, a || ' ' || b AS tok FROM q), c AS (SELECT id, tok FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_MAC_TOK}, tok) <= 50), k AS (SELECT tok, count(*) AS n FROM c GROUP BY tok), {_noisy(64)}")
def dp_noisy_bigrams(spark, sf_dir):
    """The same for bigrams with epsilon 64: at most 50 distinct ones of each document."""
    pairs = ngrams.pair_lists(documents(spark, sf_dir))
    return ngrams.laplace_counts(ngrams.capped_lists(pairs, 50, SECRET), *noise_of(64), SECRET)


@query("linkage_candidates", """WITH p AS (SELECT c_custkey AS person, lower(n_name) AS nation, lower(c_mktsegment) AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey),
x AS (SELECT person AS id, CASE WHEN person % 3 = 0 THEN segment ELSE nation || ' ' || segment END AS t, person % 3 = 0 AS one FROM p)
SELECT x.id, CASE WHEN one THEN 1 ELSE 2 END::BIGINT AS active, count(*) AS candidates, min(p.person) AS first FROM x JOIN p ON p.segment = (SELECT q.segment FROM p q WHERE q.person = x.id) AND (one OR p.nation = (SELECT q.nation FROM p q WHERE q.person = x.id)) GROUP BY ALL""")
def linkage_candidates(spark, sf_dir):
    """How many customers fit what a text says about its subject."""
    nation = table(spark, sf_dir, "nation")
    people = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("person"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))
    said = F.when(F.col("person") % 3 == 0, F.concat(F.lit("works in "), "segment", F.lit("."))).otherwise(F.concat(F.lit("from "), "nation", F.lit(", in "), "segment", F.lit("!")))
    return ngrams.linkage(people.select(F.col("person").alias("id"), said.alias("text")), people, ["nation", "segment"])


@query("canary_exposure", """WITH s AS (SELECT l_orderkey % 50 AS canary, round(l_extendedprice, 2) AS logp FROM lineitem), p AS (SELECT canary, max(logp) - 1000 * (canary % 7) AS mine FROM s GROUP BY canary)
SELECT canary, round(log2(count(*) + 1) - log2(count_if(logp >= mine) + 1), 4) AS exposure FROM s JOIN p USING (canary) GROUP BY canary""")
def canary_exposure(spark, sf_dir):
    """How far a planted value stands out from the candidates of its canary."""
    line = table(spark, sf_dir, "lineitem")
    others = line.select((F.col("l_orderkey") % 50).alias("canary"), F.lit(False).alias("planted"), F.round("l_extendedprice", 2).alias("logp"))
    planted = others.groupBy("canary").agg((F.max("logp") - 1000 * (F.col("canary") % 7)).alias("logp")).select("canary", F.lit(True).alias("planted"), "logp")
    return ngrams.exposure(others.unionByName(planted))


@query("word_wer", "SELECT c_custkey, (1 + (c_custkey % 3 = 0)::INT + 2 * (c_custkey % 5 = 0)::INT + (c_custkey % 7 = 0)::INT)::INT AS edits FROM customer")
def word_wer(spark, sf_dir):
    """Word errors of transcripts with a word replaced, and others dropped and put in."""
    key, when = F.col("c_custkey").cast("string"), lambda n, yes, no: F.when(F.col("c_custkey") % n == 0, yes).otherwise(no)
    ref = F.concat_ws(" ", F.lit("please pay"), key, F.lit("dollars to"), F.lower("c_mktsegment"), F.lit("now please"))
    hyp = F.concat_ws(" ", F.lit("Please  pay"), when(3, "x", key), F.lit("dollar to"), when(5, "", F.lower("c_mktsegment")), when(5, "please", "now please"), when(7, "sir", ""))
    return table(spark, sf_dir, "customer").select("c_custkey", metrics.word_errors(ref, hyp).alias("edits"))


@query("nbest_rerank", "SELECT id, hyp FROM (SELECT l_orderkey AS id, CAST(l_linenumber AS VARCHAR) AS hyp, l_quantity + 0.5 * l_discount AS s FROM lineitem) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, hyp) = 1")
def nbest_rerank(spark, sf_dir):
    """The best of each list of hypotheses under two scores."""
    hyps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("string").alias("hyp"), F.col("l_quantity").alias("lp"), F.col("l_discount").alias("lm"))
    return ngrams.rerank(hyps, 0.5)


def clean_sql(text: str) -> str:
    """The annotation rules as SQL."""
    rules = [(r"<[a-z]+>([^<]*):([^<]*)</[a-z]+>", r"\2"), (r"<[^>]*>|\([^)]*\)|\[[^\]]*\]", " "), (r"\b\w+~|~\w+\b", " "), ("[_-]", " "), ("[#!]", ""), (r"\s+", " ")]
    for pattern, by in rules:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"trim({text})"


@query("raw_clean", f"SELECT conv_id, turn, {clean_sql('text')} AS text FROM conversations")
def raw_clean(spark, sf_dir):
    """All lines as plain text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tr.clean_annotations(F.col("text")).alias("text"))


_ANNOTATED = ("'<mandarin>zhe:'", "CAST(conv_id AS STRING)", "'</mandarin> [noise] '", "text", "' (laugh) wo~ ~rld #so!'")


@query("raw_clean_annotated", f"SELECT conv_id, turn, {clean_sql('(' + ' || '.join(_ANNOTATED) + ')')} AS text FROM conversations")
def raw_clean_annotated(spark, sf_dir):
    """All lines with tags, code switches and cut-offs around them, as plain text."""
    line = F.concat(*[F.lit(x.strip("'")) if x.startswith("'") else F.expr(x) for x in _ANNOTATED])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tr.clean_annotations(line).alias("text"))


@query("speaker_split", "SELECT conv_id, turn, 'Speaker' || (turn % 2 + 1) AS speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def speaker_split(spark, sf_dir):
    """Conversations with inline speaker tags, split again."""
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    said = F.concat(F.lit("<Speaker"), F.col("t") % 2 + 1, F.lit(">: "), F.regexp_replace("text", r"\s+", " "))
    joined = rows.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("t", said.alias("s")))).alias("p")).select("id", F.array_join("p.s", "").alias("answer"))
    return tr.split_speakers(joined).where("text <> ''").select(F.col("id").alias("conv_id"), "turn", "speaker", "text")
