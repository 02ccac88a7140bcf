"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, BPE.

Each stage works on what its predecessor kept. Rows are documents of their own, also where they share a doc_id or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylark.llm import bpe, decontaminate, jaccard_join, language, secrets
from quaylark.session import stored

#: Stands for a secret that was taken out of a text.
SECRET_MARK = "[SECRET]"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; a missing lang is filled in. Null texts, texts without a letter and texts none of
    whose n-grams any language has go."""
    filters = language.fit(docs)
    rows = language.identify(docs.select(F.struct(*(f"`{c}`" for c in docs.columns if c != "text")).alias("row"), "text"), filters)
    rows = rows.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("evidence") > 0))
    told = {"text": F.col("text"), "lang": F.coalesce("row.lang", "lang_pred")}
    return rows.select(*(told.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of alike rows: the one with the least doc_id (null is the least). Rows are compared by their own
    texts, whether or not others have their doc_id; rows with equal doc_id and text are one."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    _, linked = jaccard_join.linked_rows(keyed.select(F.col("_key").alias("doc_id"), "text"))
    linked = stored(linked.withColumnRenamed("id", "_key"), "alike")
    ids = keyed.select("_key", "doc_id").join(linked, "_key")
    kept = stored(ids.groupBy("component").agg(F.min(F.struct("doc_id", "_key")).alias("least")).select(F.col("least._key").alias("_key")), "kept")
    gone = linked.join(kept, "_key", "left_anti").select("_key")
    order = Window.partitionBy("_key", "doc_id").orderBy(F.xxhash64(*docs.columns))
    return keyed.join(gone, "_key", "left_anti").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place", "_key")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages of more than a twentieth of their words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select("doc_id", "text", F.struct(*(f"`{c}`" for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))
    clean = decontaminate.contamination(rows, items, carry=["text", "row"], named=False).where(~decontaminate.contaminated())
    return clean.select(*(F.col(c if c in ("doc_id", "text") else f"row.`{c}`").alias(c) for c in docs.columns))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with SECRET_MARK in place of each secret; n_chars counts what is left."""
    rows = secrets.scan(docs.select(F.struct(*(f"`{c}`" for c in docs.columns if c != "text")).alias("row"), "text"), mark=SECRET_MARK)
    told = {"text": F.col("clean"), "n_chars": F.when(F.col("spans") != "", F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return rows.select(*(told.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text decoded from them."""
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.default_path(), decoded=False)
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("bpe", bpe_stage),
]

#: A trained filter, sets of documents that are alike and a tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
