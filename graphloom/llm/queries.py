"""The queries of this subpackage: one for each operator, over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, line_dedup, media, ngram_join, packing, piece_codec, quality, secret_scan, sharding, token_records

SHARD_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trips(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return sharding.assign_shards(docs, ["doc_id"], F.octet_length("text"), SHARD_BYTES)


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
x AS (SELECT doc_id, n_bytes, h, b.bits, h >> CAST(60 - b.bits AS INTEGER) AS p FROM d, (SELECT unnest(range(0, 61)) AS bits) b),
s AS (SELECT bits, p, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM x GROUP BY bits, p),
leaf AS (
  SELECT x.doc_id, x.n_bytes, x.h, x.bits, s.shard_bytes, s.shard_rows,
         row_number() OVER (PARTITION BY x.doc_id ORDER BY x.bits) AS rn
  FROM x JOIN s ON x.bits = s.bits AND x.p = s.p WHERE s.shard_bytes <= {SHARD_BYTES})
SELECT doc_id, n_bytes, CAST(bits AS INTEGER) AS depth,
       CAST(bits AS VARCHAR) || ':' ||
       CASE WHEN level = 0 THEN '' ELSE substr(printf('%015x', h), 1, CAST(3 * level AS INTEGER)) END ||
       upper(printf('%03x', (h >> CAST(48 - 12 * level AS INTEGER)) % 4096 >> CAST(12 * level + 12 - bits AS INTEGER))) AS shard_id,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
FROM (SELECT *, CASE WHEN bits = 0 THEN 0 ELSE (bits - 1) // 12 END AS level FROM leaf WHERE rn = 1)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(documents(spark, sf_dir))
    counts = [secret_scan.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), words=4, percent=85).withColumnRenamed("id", "doc_id")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_features(documents(spark, sf_dir))
    # time and code of each pair as 16 hex digits
    pairs = F.zip_with("times", "codes", lambda t, c: F.concat(F.lpad(F.hex(t), 8, "0"), F.lpad(F.hex(c), 8, "0")))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.array_join(pairs, "").alias("feature"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, forest).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit_text_model(docs)
    return language.identify(docs, model, F.col("text"), F.col("source"), F.col("lang"), {"doc_id": F.col("doc_id")})


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages: declared by the markup, host and suffix from the address, text without tags."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = language.fit_text_model(documents(spark, sf_dir))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)
    return language.identify(pages, model, bare, F.parse_url("url", F.lit("HOST")), declared, {"page_id": F.col("page_id")})


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 0)
    return packing.pack(pieces)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_media_columns": op6_media_columns,
    "op7_token_records": op7_token_records,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "pages_language": pages_language,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLES: dict[str, str] = {"op2_sharding": OP2_SQL}
