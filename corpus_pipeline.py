"""The corpus pipeline: each stage applies one operator to the table that the stage before it has written.

Rows with a null id are handled like others and come last where ids decide; rows of one id with different texts are
documents of their own; rows of equal id and text count as one. A text that is null or empty has no language and goes. An
empty table passes through as an empty one; of ties the smallest id stays; the length of texts has no bound; columns
besides those of documents, whatever their names, are handed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, packing, passages, secrets, simhash
from millrace.llm.common import hold_batches, materialize

#: A document's language is rejected below this share of its words.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; fills in a language that is null."""
    hold_batches(spark)
    field = langid.fit(langid.training_rows(docs))
    got = langid.identify(docs, field, lang_pred="_millrace_lang", score="_millrace_score")
    got = got.filter((F.col("_millrace_lang") != "und") & (F.col("_millrace_score") >= LEAST_SCORE))
    return got.withColumn("lang", F.coalesce("lang", "_millrace_lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group at Jaccard 0.8 or more in five-word shingles; of repeated rows, one."""
    hold_batches(spark)
    return simhash.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages but for their first occurrence; drops documents of which nothing is left."""
    hold_batches(spark)
    cut = passages.without(docs, passages.repeated(docs))
    return cut.filter(F.trim("text") != "").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret."""
    hold_batches(spark)
    clean = secrets.redact(docs, secrets.scan(docs, secrets.train(spark, docs=docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    hold_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The stages' models and hashes have no SQL form; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
