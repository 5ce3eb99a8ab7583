"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import byte_bpe
from loomstone.llm.common import crc_mod, documents
from loomstone.llm.ctw import score_texts
from loomstone.llm.ego_join import near_vectors
from loomstone.llm.licenses import scan_licenses
from loomstone.llm.line_dedup import dedup_lines
from loomstone.llm.lz_fingerprint import edits_and_neighbours
from loomstone.llm.packing import pack
from loomstone.llm.quality import classify
from loomstone.llm.simhash import near_groups
from loomstone.llm.warc import resolve_revisits, two_crawls
from loomstone.plans.catalogue import Catalogue

CATALOGUE = Catalogue()

OP1_SQL = """
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
drops AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(d.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE d.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN drops d ON lines.key = d.key
GROUP BY doc_id
"""


@CATALOGUE.add("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return dedup_lines(docs, min_docs=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@CATALOGUE.add("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir, "doc_id", "text"), words_each=3, max_bits=3)


@CATALOGUE.add("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = classify(documents(spark, sf_dir, "doc_id", "text"), labels, train_on=lambda c: crc_mod(c, 4) != 2, threshold=0.7)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@CATALOGUE.add("op4_lz_fingerprint")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits_and_neighbours(documents(spark, sf_dir, "doc_id", "text"))


@CATALOGUE.add("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(documents(spark, sf_dir, "doc_id", "text"), path, pattern).select("doc_id", "ids")
    decoded = byte_bpe.decode(ids, path, pattern).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")
    return byte_bpe.with_digest(decoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


OP6_SQL = """
WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS MATERIALIZED (
  SELECT * FROM vectors WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
     AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.k <> b.k AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT vec_id, vec_id AS other FROM vectors UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM vectors v JOIN least ON least.vec_id = v.vec_id
"""


@CATALOGUE.add("op6_ego_embedding_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), threshold=0.95)


@CATALOGUE.add("op7_ctw_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 10) == 0
    out = score_texts(documents(spark, sf_dir, "doc_id", "text"), ~held_out)
    return out.withColumn("held_out", held_out)


@CATALOGUE.add("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text", "source"), capacity=2048)


@CATALOGUE.add("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licenses(documents(spark, sf_dir).select("doc_id", path.alias("path"), "text"))


OP10_SQL = """
WITH base AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
parts AS (
  SELECT page_id, digest, n, regexp_extract(bare, '^[^?]*', 0) AS path, regexp_extract(bare, '[?](.*)$', 1) AS query FROM base),
urls AS (
  SELECT page_id, digest, n,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(path, '^[^/]*', 0)), '^.*@', ''), ':(80|443)$', ''), '^www[.]', '')
         || regexp_replace(regexp_extract(path, '^[^/]*(.*)$', 1), '/+$', '') AS address,
         array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> ''
           AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))), '&') AS args
  FROM parts),
pages2 AS (SELECT page_id, digest, n, address || CASE WHEN args = '' THEN '' ELSE '?' || args END AS canonical_url FROM urls),
latest AS (SELECT canonical_url, max(page_id) AS refers_to FROM pages2 GROUP BY canonical_url),
joined AS (
  SELECT p.page_id, p.canonical_url, l.refers_to, p.digest, s.n, substr(p.digest, 1, 16) = substr(s.digest, 1, 16) AS same
  FROM pages2 p LEFT JOIN latest l ON p.canonical_url = l.canonical_url LEFT JOIN pages2 s ON s.page_id = l.refers_to)
SELECT page_id, canonical_url, refers_to,
       CASE WHEN refers_to IS NULL THEN 'missing' WHEN same THEN 'resolved' ELSE 'mismatch' END AS status,
       CASE WHEN same THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html'
         || chr(10) || 'date: ' || page_id || chr(10) || 'etag: W/"' || substr(digest, 1, 16) || '"' || chr(10) || 'x-crawl: 1' END AS headers
FROM joined
"""


@CATALOGUE.add("op10_warc_revisits", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(two_crawls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(F.col("record_id").alias("page_id"), "canonical_url", "refers_to", "status", F.array_join(lines, "\n").alias("headers"))
