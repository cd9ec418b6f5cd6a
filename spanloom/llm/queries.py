"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.durable import durable, new_path
from spanloom.llm import embed_dedup, langid, manifest, media, mixing, neighbours, packing, resample, toxicity, urlfilter
from spanloom.llm.ngram_join import ngram_components
from spanloom.llm.sharding import shard_documents
from spanloom.llm.stages import labelled
from spanloom.llm.tokencount import TokenRollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents whose id's crc32 leaves another remainder than 1."""
    docs = _table(spark, sf_dir, "documents")
    late = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(docs.where(~late))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", late.alias("held_out"), "lang_pred", "score")


#: Where the public vocabulary lies, and the name of its version.
RANKS_FILE, RANKS_VERSION = "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k"


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches: all documents, then without exact copies, then without licence lines.

    The first batch is committed twice, which must not count anything twice.
    """
    docs = _table(spark, sf_dir, "documents")
    rollup = TokenRollup(spark, new_path(spark, "rollup"), RANKS_FILE, RANKS_VERSION)
    upsert = docs.select(F.lit("upsert").alias("op"), "doc_id", F.lit(1).alias("seq"), "text", "source", "lang")
    rollup.commit("load", upsert)
    rollup.commit("load", upsert)
    same = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"))
    first = same.groupBy("same").agg(F.min("doc_id").alias("first"))
    copies = same.join(first, "same").where("doc_id <> first").select("doc_id")
    none = F.lit(None).cast("string")
    rollup.commit("copies", copies.select(F.lit("delete").alias("op"), "doc_id", F.lit(1).alias("seq"), none.alias("text"), none.alias("source"), none.alias("lang")))
    licence = r"(?m)^.*Licensed under [^\n]*\n?"
    left = docs.where(F.col("text").contains("Licensed under ")).join(copies, "doc_id", "left_anti")
    rollup.commit("licences", left.select(F.lit("upsert").alias("op"), "doc_id", F.lit(1).alias("seq"), F.regexp_replace("text", licence, "").alias("text"), "source", "lang"))
    return rollup.totals()


@_query
def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a Netpbm image with an NPY tile, read back, with checksums and difference hash."""
    return media.media_digests(durable(media.text_media(_table(spark, sf_dir, "documents")), "media"))


@_query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near equal bytes."""
    placed = shard_documents(_table(spark, sf_dir, "documents"), 40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@_query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of at least 0.9."""
    return ngram_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


ORACLES["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 3
           THEN list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.x, r.m FROM r JOIN e ON e.y = r.d
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(m) FROM r WHERE r.d = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels of the documents whose id's crc32 isn't divisible by 5."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(labelled(docs, _table(spark, sf_dir, "labels")))
    late = langid.held_out(F.col("doc_id"), 5, 0).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", late, "score", "predicted", "n_offending", "worst")


@_query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all vectors with a cosine of at least 0.93 within their label."""
    return embed_dedup.link_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in bins of 16 KiB that repeat no source and no text."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@_query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in blocks of 64 KiB, scheduled to the square root of each source's bytes."""
    return mixing.schedule(_table(spark, sf_dir, "documents"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: The rules of the contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


ORACLES["op9_url_filters"] = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT p.*, h || q AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""


ORACLES["op6_embedding_dedup"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (SELECT vec_id AS d, vec_id AS m FROM embeddings UNION SELECT l.x, r.m FROM r JOIN l ON l.y = r.d
), c AS (SELECT d, min(m) AS m FROM r GROUP BY d), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, vec_id = c.m AS kept
FROM embeddings JOIN c ON c.d = vec_id LEFT JOIN n ON n.x = vec_id
"""


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents in a tree over each source and one over the sources, checked against texts without line feeds."""
    docs = _table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    rows = docs.withColumn("leaf", manifest.leaf_digest())
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0) & F.col("text").contains("\n")
    found = F.when(hit, manifest.leaf_digest(text=F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    proved = manifest.proofs(rows.select("doc_id", "source", "leaf", found.alias("found")))
    back = proved.withColumn("folded_root", manifest.folded(F.col("found"), F.col("left"), F.col("right")))
    proof = F.sha2(manifest.proof_text(F.col("left"), F.col("right")), 256).alias("proof_sha256")
    return back.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 in SQL: every byte's share depends on the byte and on how many bytes follow it, and shares are added by xor.
_CRC_SQL = """
  bits AS (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) t(b)
  ), share(d, b, c) AS (
    SELECT 0, b, c FROM bits UNION ALL SELECT d + 1, s.b, xor(s.c >> 8, t.c) FROM share s JOIN bits t ON t.b = s.c & 255 WHERE d + 1 < (SELECT max(octet_length(encode(s))) FROM word)
  ), lead(n, c) AS (
    SELECT 0::BIGINT, 4294967295::BIGINT UNION ALL SELECT n + 1, xor(l.c >> 8, t.c) FROM lead l JOIN bits t ON t.b = l.c & 255 WHERE n < (SELECT max(octet_length(encode(s))) FROM word)
  ), part AS (SELECT s, hex(encode(s)) AS h, octet_length(encode(s)) AS n FROM word
  ), byte AS (SELECT s, n, i, ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT AS b FROM part, unnest(range(n)) AS u(i)
  ), crc AS (
    SELECT s, xor(xor(any_value(l.c), bit_xor(k.c)), 4294967295) AS c FROM byte JOIN share k ON k.d = n - 1 - i AND k.b = byte.b JOIN lead l ON l.n = byte.n GROUP BY s
  )"""

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE word AS (SELECT DISTINCT doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),{_CRC_SQL},
rows AS (
  SELECT d.*, CASE WHEN c % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents d LEFT JOIN crc ON s = doc_id::VARCHAR
), said AS (
  SELECT doc_id, source, concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS a, coalesce(octet_length(encode(found)) || ':' || found, '-') AS b FROM rows
), leaf AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256(head || a) AS leaf, sha256(head || b) AS found,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || a)) - 1 AS pos FROM said
), node(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM leaf
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM node WHERE n > 1 GROUP BY tree, lvl, pos // 3
), sub AS (SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM node WHERE n = 1
), upper(lvl, pos, h, n) AS (
  SELECT 0, place, subroot, count(*) OVER () FROM sub
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3
), every AS (
  SELECT tree, lvl, pos, h FROM node UNION ALL SELECT NULL, lvl, pos, h FROM upper
), run AS (SELECT tree, lvl, pos // 3 AS run, list(h ORDER BY pos) AS own FROM every GROUP BY ALL
), top AS (SELECT lvl AS height, h AS root FROM upper WHERE n = 1
), step AS (
  SELECT doc_id, l.tree, l.pos AS leafpos, k AS lvl, CASE WHEN k < height THEN l.tree END AS of, CASE WHEN k < height THEN k ELSE k - height END AS at,
    CASE WHEN k < height THEN l.pos // (3 ** k)::BIGINT ELSE place // (3 ** (k - height))::BIGINT END AS p
  FROM leaf l JOIN sub USING (tree), unnest(range(height + (SELECT height FROM top))) AS u(k)
), sides AS (
  SELECT s.doc_id, s.tree, leafpos, s.lvl, array_to_string(own[: p % 3], '') AS before, array_to_string(own[p % 3 + 2 :], '') AS after
  FROM step s JOIN run r ON r.tree IS NOT DISTINCT FROM s.of AND r.lvl = s.at AND r.run = p // 3
), proof AS (
  SELECT tree, leafpos, list(struct_pack(l := before, r := after) ORDER BY lvl) AS way FROM sides GROUP BY ALL
), folded AS (
  SELECT doc_id, leaf, subroot, root, coalesce(way, []) AS way,
    list_reduce(list_prepend(struct_pack(l := found, r := ''), coalesce(way, [])), lambda h, s: struct_pack(l := sha256(s.l || h.l || s.r), r := '')).l AS folded_root
  FROM leaf JOIN sub USING (tree) LEFT JOIN proof ON proof.tree = leaf.tree AND leafpos = leaf.pos, top
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@_query
def op12_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, voted by its nearest labelled documents whose id's crc32 isn't divisible by 5."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    late = langid.held_out(F.col("doc_id"), 5, 0).alias("held_out")
    model = neighbours.fit(labelled(docs, labels, "quality"))
    return neighbours.score(docs.select("doc_id", "text"), model).select("doc_id", late, "score", "predicted")


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents of at least 20 words, drawn by their likeness to the benchmark's texts."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op13_importance_resampling"] = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT NULL, false, text FROM benchmark
), words AS (
  SELECT row_number() OVER () AS k, doc_id, own,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT k, own, unnest(w) AS s FROM words UNION ALL SELECT k, own, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
), word AS (SELECT DISTINCT s FROM runs),{_CRC_SQL},
found AS (SELECT k, own, c % 10000 AS bucket, count(*) AS n FROM runs JOIN crc USING (s) GROUP BY ALL
), bucket AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t FROM found GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM bucket) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM bucket) + 10000)::DOUBLE)))::BIGINT AS g FROM bucket
), mean AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM found JOIN gain USING (bucket) WHERE own GROUP BY k
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS fit,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN mean USING (k) WHERE own
), placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (fit) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN fit AND r <= 25 * n // 100 THEN r END AS rank FROM placed
"""


ORACLES["op4_sharding"] = """
WITH tbl AS (
  SELECT list(c ORDER BY b) AS l FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) t(b))
), d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (SELECT doc_id, size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM d
), c AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc FROM b, tbl
), p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, crc, size) - size AS before, sum(size) OVER () AS total FROM c
), s AS (SELECT *, least(39, (2 * before + size) * 40 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
