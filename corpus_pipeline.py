"""Training corpus from the table documents: quality rules, near-duplicates, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm import near_duplicates, packing, quality, secrets, similar_sets
from tidebars.llm.queries import byte_tokens
from tidebars.sources.storage import scratch_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, text="text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest number stays."""
    return near_duplicates.keep_one(docs, key="doc_id", text="text", find=similar_sets.similar_sets)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, whose length follows; no document goes."""
    size = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return secrets.mask_secrets(docs, text="text").withColumn("n_chars", size)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    return packing.pack_sets(docs, key="doc_id", text="text", **byte_tokens())


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("secret scans", secret_scans), ("best-fit packing", best_fit_packing)]

# Similarity classes, trained models and packing have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
