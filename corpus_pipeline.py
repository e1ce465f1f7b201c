"""The training-data pipeline over documents: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes documents(doc_id, text, lang, source, n_chars) and all but the last return these columns. A document is
told apart by doc_id and text together, so null and repeated doc_ids lose no clean text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontamination, jaccard, language_id, line_dedup, mixing
from lexmill.llm.common import forget, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those that op 3 calls `und` go (null, empty and letterless texts).

    Each row is judged by itself, repeated ones alike. Without any labelled text nothing can be told and all are `und`.
    """
    model = language_id.train(docs)
    return language_id.identify(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a document that loses all of its lines goes.

    null texts have no lines and stay as they are; equal rows are one document and have the same result.
    """
    out = line_dedup.dedup_lines(docs)
    out = out.where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the document with the least doc_id (null last), of equal rows one.

    Texts without words, null ones too, are in no group and stay.
    """
    return jaccard.one_of_each(docs).select(*COLUMNS)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a test item; null and empty texts hold none. Equal rows go together."""
    leaks = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak"), "text_hash").distinct()
    return docs.join(leaks, docs.doc_id.eqNullSafe(leaks.leak) & (F.xxhash64(docs.text) == leaks.text_hash), "left_anti").select(*COLUMNS)


def by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: one row for each row of docs; null texts have no words, a null source is the last."""
    return mixing.Mix(docs).taken()


STAGES = [("language ID", by_language), ("line dedup", by_lines), ("near duplicates", by_similarity), ("decontamination", by_benchmark), ("mixing", by_source)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table: each is stored, read back as the next one's input, and deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
