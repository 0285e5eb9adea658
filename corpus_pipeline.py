"""From raw documents to packed token sequences: five stages, each the work of one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, line_dedup, ngram_join, packing, secret_scan, store
from graphloom.session import ready


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is settled stay: text, declared language and the source's prior together.

    Null, empty and letterless texts go, as no text speaks for a language; equal rows fare alike; rows without an id
    are judged like others, but aren't in the model's sample. An empty table gives no rows.
    """
    ready(spark)
    model = language.fit_text_model(docs)
    carry = {f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    found = language.identify(docs, model, F.col("text"), F.col("source"), F.col("lang"), carry)
    return found.filter("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later text; documents that lose all their words go with them.

    Equal rows lose the same lines; rows without an id, null, empty and blank texts stay as they are. An empty table
    gives no rows.
    """
    ready(spark)
    rows = line_dedup.dedup(docs)
    left = rows.filter((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the least id stays, once.

    Equal rows are one document. Different texts of one id are documents of their own, which come before the others
    of their groups; rows without an id stay, as do null, empty and blank texts. An empty table gives no rows.
    """
    ready(spark)
    text = F.xxhash64("text")
    repeats = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(text) != F.max(text)).alias("differ")).filter("n > 1")
    repeats = store.written(repeats.select("doc_id", "differ"), "repeated-ids")
    if repeats.isEmpty():
        found = ngram_join.jaccard_components(docs)
        gone = found.filter("component_id <> id").select(F.col("id").alias("doc_id")).distinct()
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    own = -1 - F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    known = docs.join(repeats.withColumnRenamed("differ", "__gl_differ"), "doc_id", "left")
    known = store.written(known.withColumn("__gl_node", F.when(F.col("__gl_differ"), own).otherwise(F.col("doc_id"))), "numbered")
    found = ngram_join.jaccard_components(known, "__gl_node")
    gone = found.filter("component_id <> id").select(F.col("id").alias("__gl_node")).distinct()
    kept = known.join(gone.hint("merge"), "__gl_node", "left_anti")
    once = kept.filter("__gl_differ is not null").dropDuplicates(["__gl_node"])
    return kept.filter("__gl_differ is null").unionByName(once).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay, null and empty texts and equal rows too."""
    ready(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: a row for each piece of a document with its place.

    A null or empty text is one piece of the end id; equal rows are packed each; an empty table gives no rows.
    """
    ready(spark)
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 0))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Alignment, fitted models and packing can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
