"""Registered queries of this package, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm import alignment, byte_pairs, language_id, language_model, manifest, near_duplicates, nearest, packing, page_text, quality, revisits, secrets, texts, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as parameter sets: text as description, number as name."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("name"), F.col("text").alias("description"))


@register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality.quality_report(noted(spark, sf_dir))
    return r.select(F.col("name").alias("doc_id"), *quality.COUNTS, "base_failed", "kept")


@register
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(noted(spark, sf_dir))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("name").alias("doc_id"), *[count(k) for k, *_ in secrets.KINDS], F.sha2(told(F.col("base_spans")), 256).alias("base_sha256"),
        told(F.sort_array(F.concat("base_spans", "added_spans"))).alias("spans"))


@register
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(noted(spark, sf_dir))
    return found.select(F.col("name").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def byte_tokens() -> dict:
    """The 50k byte-level vocabulary: the same ids as the file for the library tokenizers,
    special strings included."""
    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": {"<|endoftext|>": 50256}}


@register
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_sets(noted(spark, sf_dir), **byte_tokens())
    return packed.select(F.col("name").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register
def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_pairs.decode(byte_pairs.encode(noted(spark, sf_dir), path, public_tokenizers.PATTERN), path)
    return done.select(F.col("name").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(noted(spark, sf_dir), path, public_tokenizers.PATTERN).withColumnRenamed("name", "doc_id")


@register
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("window_id"), F.col("embedding").alias("closes"))
    found = nearest.nearest(vectors, F.col("window_id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures made of the pages: each page is a full response, a third of them are
    asked for again a day later, with an entity tag, a time of last modification, or
    the tag of something else. Payloads go no further than their digest."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id)")
    m = F.col("page_id") % 12
    tag = F.when(m < 9, F.concat(F.lit('W/"'), F.substring("digest", 1, 8), F.lit('"')))
    modified = F.concat(F.lit("day "), (F.col("page_id") % 30).cast("string"))
    stored = F.map_filter(F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Date"), at.cast("string"), F.lit("Content-Type"), F.lit("text/html")), lambda k, v: v.isNotNull())
    again = F.map_filter(F.create_map(
        F.lit("etag"), F.when(m == 0, F.concat(F.lit('"'), F.substring("digest", 1, 8), F.lit('"'))).when(m == 6, F.lit('"other"')),
        F.lit("last-modified"), F.when(m == 9, modified).when(m == 3, F.lit("day 99")), F.lit("date"), (at + F.expr("interval 1 day")).cast("string"),
        F.lit("content-type"), F.lit("none")), lambda k, v: v.isNotNull())
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit(200).alias("status"), stored.alias("headers"), "digest")
    revisits = pages.where("page_id % 3 = 0").select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (at + F.expr("interval 1 day")).alias("ts"),
                                                     F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return full.unionByName(revisits)


@register
def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisits.resolve_revisits(captures(spark, sf_dir))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return done.select("record_id", "canonical", "resolution", "refers_to", "matched_by", told.alias("headers"), "digest")


ORACLES["op7_revisit_resolution"] = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, TIMESTAMP '2024-01-01' + to_seconds(page_id) AS seen, page_id % 12 AS m,
         'day ' || (page_id % 30) AS modified, regexp_replace(trim(url), '#.*$', '', 's') AS bare
  FROM pages
), q AS (
  SELECT *, regexp_matches(bare, '^(?i)https?://') AS web, regexp_extract(bare, '^(?i)https?://([^/?]*)([^?]*)\??(.*)$', 1) AS host,
         regexp_extract(bare, '^(?i)https?://([^/?]*)([^?]*)\??(.*)$', 2) AS path, regexp_extract(bare, '^(?i)https?://([^/?]*)([^?]*)\??(.*)$', 3) AS query
  FROM p
), u AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x),
           '^(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') AS params
  FROM q
), c AS (
  SELECT *, CASE WHEN web THEN regexp_replace(regexp_replace(regexp_replace(lower(host), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '')
           || regexp_replace(path, '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END ELSE bare END AS canonical
  FROM u
), f AS (
  SELECT page_id * 2 AS record_id, canonical, seen, digest, modified, CASE WHEN m < 9 THEN '"' || left(digest, 8) || '"' END AS tag FROM c WHERE canonical IS NOT NULL
), r AS (
  SELECT page_id * 2 + 1 AS record_id, canonical, seen + INTERVAL 1 DAY AS seen,
         CASE m WHEN 0 THEN '"' || left(digest, 8) || '"' WHEN 6 THEN '"other"' END AS tag, CASE m WHEN 9 THEN modified WHEN 3 THEN 'day 99' END AS modified
  FROM c WHERE page_id % 3 = 0
), j AS (
  SELECT r.*, f.record_id AS refers_to, f.digest AS f_digest, f.tag AS f_tag, f.modified AS f_modified, f.seen AS f_seen,
         row_number() OVER (PARTITION BY r.record_id ORDER BY f.seen DESC, f.record_id DESC) AS n
  FROM r LEFT JOIN f ON f.canonical = r.canonical AND (f.seen < r.seen OR f.seen = r.seen AND f.record_id < r.record_id)
), k AS (
  SELECT *, CASE WHEN tag IS NOT NULL AND f_tag IS NOT NULL THEN 'etag' WHEN modified IS NOT NULL AND f_modified IS NOT NULL THEN 'last-modified' END AS how FROM j WHERE n = 1
), l AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'missing' WHEN how IS NULL THEN 'unchecked'
         WHEN CASE how WHEN 'etag' THEN tag = f_tag ELSE modified = f_modified END THEN 'resolved' ELSE 'mismatch' END AS resolution FROM k
)
SELECT record_id, canonical, resolution, refers_to, CASE WHEN resolution = 'resolved' THEN how END AS matched_by,
       CASE WHEN resolution = 'resolved' THEN
         'content-type=text/html;date=' || strftime(seen, '%Y-%m-%d %H:%M:%S') || coalesce(';etag=' || coalesce(tag, 'W/' || f_tag), '') || ';last-modified=' || coalesce(modified, f_modified)
       ELSE 'content-type=none;date=' || strftime(seen, '%Y-%m-%d %H:%M:%S') || coalesce(';etag=' || tag, '') || coalesce(';last-modified=' || modified, '') END AS headers,
       CASE WHEN resolution = 'resolved' THEN f_digest END AS digest
FROM l
"""


@register
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@register
def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("name").cast("string")) % 10 == 0
    return language_model.score_sets(noted(spark, sf_dir), held_out).withColumnRenamed("name", "doc_id")


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", texts.UPPER, texts.LOWER)).otherwise(F.col("text"))
    # Only leaves that tampering changes are carried beside the own ones.
    shown = F.when(~lower.eqNullSafe(F.col("text")), manifest.leaf_digest([*fields[:-1], lower]))
    told = manifest.merkle_manifest(docs.withColumn("shown", shown), fields, ["source"], ["doc_id"], ["doc_id", "shown"])
    told = told.withColumn("folded_root", manifest.folded_root(F.coalesce("row.shown", "leaf"), "path"))
    return told.select("row.doc_id", "leaf", "subroot", "root", manifest.proof_digest("path").alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def _merkle_sql(levels: int = 7, upper: int = 4) -> str:
    """The trees level by level: enough levels for 16**7 leaves a source."""
    def tree(name: str, depth: int) -> str:
        out = ""
        for k in range(depth):
            out += f"""
, {name}r{k} AS (SELECT tree, pos // 16 AS run, any_value(n) AS n, string_agg(h, '' ORDER BY pos) AS kids FROM {name}{k} GROUP BY tree, pos // 16)
, {name}{k + 1} AS (SELECT tree, run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN kids ELSE sha256(kids) END AS h FROM {name}r{k})"""
        return out

    def fold(source: str, name: str, table: str, depth: int, at: str) -> str:
        out, last = "", source
        for k in range(depth):
            left, right = f"left(kids, CAST(64 * (s.{at} % 16) AS INT))", f"substr(kids, CAST(64 * (s.{at} % 16) + 65 AS INT))"
            out += f"""
, {name}{k} AS (SELECT s.* REPLACE (CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
    CASE WHEN r.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded, s.{at} // 16 AS {at})
    FROM {last} s JOIN {table}r{k} r ON r.tree = s.{'tree' if at == 'pos' else 'zero'} AND r.run = s.{at} // 16)"""
            last = f"{name}{k}"
        return out

    told = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    bits = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    crc = (f"list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, c: "
           f"list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: {bits}, xor(x, c)), CAST(4294967295 AS BIGINT))")
    same, own = "".join(f" || {told(c)}" for c in ("source", "lang", "n_chars"))[4:], "text"
    lower = f"translate(text, '{texts.UPPER}', '{texts.LOWER}')"
    return f"""
WITH d AS (SELECT *, xor({crc}, 4294967295) % 5 = 0 AS tampered FROM documents)
, e AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    sha256({told('doc_id')} || {same} || {told(own)}) AS h,
    sha256({told('doc_id')} || {same} || CASE WHEN tampered THEN {told(lower)} ELSE {told(own)} END) AS shown FROM d)
, a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS pos FROM e){tree('a', levels)}
, b0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM a{levels}){tree('b', upper)}
, s AS (SELECT doc_id, h AS leaf, tree, tree AS above, 0 AS zero, pos, shown AS folded, '' AS proof FROM a0){fold('s', 'f', 'a', levels, 'pos')}{fold(f'f{levels - 1}', 'g', 'b', upper, 'above')}
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.h AS verified
FROM g{upper - 1} g JOIN a{levels} t ON t.tree = g.tree CROSS JOIN b{upper} u
"""


ORACLES["op11_merkle_manifest"] = _merkle_sql()


@register
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_path, piece_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(noted(spark, sf_dir), byte_path, piece_path).withColumnRenamed("name", "doc_id")


@register
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = docs.select(F.col("doc_id").alias("name"), F.col("text").alias("description"), F.col("lang").alias("category"))
    held_out = F.coalesce(F.crc32(F.col("name").cast("string")) % 4 == 2, F.lit(False))
    told = language_id.identify(sets, language_id.train(sets, ~held_out))
    return told.select(F.col("name").alias("doc_id"), held_out.alias("held_out"), F.col("language").alias("lang_pred"), "score")
