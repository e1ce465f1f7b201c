"""The inverted index as DataFrames: postings(term, doc_id) and what derives from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import pieces, terms
from lexmill.functions.stem import with_stem
from lexmill.functions.text import surface_tokens
from lexmill.sources.scratch import step


def vocabulary(docs: DataFrame, nltk: bool = False) -> DataFrame:
    """(surface, stem): the distinct folded tokens that aren't stop words, with their stems."""
    return with_stem(docs.select(F.explode(F.array_distinct(surface_tokens(F.col("text")))).alias("surface")).distinct(), "surface", nltk=nltk)


def once(docs: DataFrame) -> bool:
    """Whether no doc_id recurs. A job over the doc_ids alone; what is worked out of a single document need then not be
    made distinct, or summed, by a shuffle."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def postings(docs: DataFrame, nltk: bool = False, post_stop: bool = True, unique: bool | None = None) -> DataFrame:
    """(term, doc_id), distinct. Tokens are made distinct, and stemmed, within each document; only if doc_ids recur are
    they shuffled. unique says whether doc_ids do not, if that is known."""
    out = terms.pairs(docs, nltk, post_stop)
    return out if (once(docs) if unique is None else unique) else out.distinct()


def term_frequencies(docs: DataFrame, nltk: bool = False, unique: bool | None = None) -> DataFrame:
    """(term, doc_id, tf): postings with counts."""
    out = terms.counts(docs, nltk)
    return out if (once(docs) if unique is None else unique) else out.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def normalized(docs: DataFrame, nltk: bool = False) -> DataFrame:
    """(doc_id, pos, term): normalised tokens in order, repeats kept; pos numbers tokens before the last filter."""
    return terms.in_order(docs, nltk)


def distinct_terms(docs: DataFrame, nltk: bool = False) -> DataFrame:
    """(term): the terms of the index."""
    return terms.distinct_terms(docs, nltk)


def posting_lists(index: DataFrame) -> DataFrame:
    """(term, df, doc_ids): sorted lists. A list is as long as its term is frequent; use postings for queries, and
    posting_blocks() where a list may be too long for one row."""
    return pieces.merged(index).select("term", "df", "doc_ids")


def posting_blocks(index: DataFrame, docs_a_block: int = 1 << 20) -> DataFrame:
    """(term, block, df, doc_ids): lists cut by ranges of doc_ids, so that no row has more than docs_a_block of them."""
    return pieces.merged(index, docs_a_block)


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def universe(index: DataFrame) -> DataFrame:
    """The documents with at least one term."""
    return index.select("doc_id").distinct()


def write_index(index: DataFrame, path: str, shards: int | None = None) -> None:
    """Parquet sorted by term, so that row-group statistics find a term's rows; sharded tables have a folder a shard.

    The index is worked out once, into a folder beside the path that is deleted at the end: ranges are sampled first.
    """
    keys = ["shard", "term", "doc_id"] if shards else ["term", "doc_id"]
    with step(index, f"{path.rstrip('/')}.unsorted") as rows:
        out = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
        (out.partitionBy("shard") if shards else out).parquet(path)


@dataclass(frozen=True)
class StoredIndex:
    """An index in a folder: tf(term, doc_id, tf) sorted by term, and documents(doc_id, len) with the number of terms of
    each document that has any (the universe)."""

    tf: DataFrame
    documents: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.tf.select("term", "doc_id")

    @property
    def universe(self) -> DataFrame:
        return self.documents.select("doc_id")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredIndex:
        return cls(spark.read.parquet(f"{path}/tf"), spark.read.parquet(f"{path}/documents"))


def store_index(docs: DataFrame, path: str, nltk: bool = False) -> StoredIndex:
    """Builds the index of docs(doc_id, text) once and writes it; queries then read what row-group statistics leave of it."""
    with step(term_frequencies(docs, nltk), f"{path}/unsorted") as rows:
        rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/tf")
        rows.groupBy("doc_id").agg(F.sum("tf").alias("len")).write.mode("overwrite").parquet(f"{path}/documents")
    return StoredIndex.open(docs.sparkSession, path)


def assign_doc_ids(files: DataFrame, path: str, offset: int = 0) -> DataFrame:
    """files(path, ...) with doc_id: offset plus the rank of path as a string.

    Rows are written to the folder `path` in ranges of files' path first, so that the counts of the ranges and the numbers
    within them come from the same rows, whatever is read of them. No task sees all rows.
    """
    spark = files.sparkSession
    ranged = files.repartitionByRange("path").sortWithinPartitions("path")
    ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))  # one row a range
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = counts.select("_part", (before + offset - F.col("first")).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn("doc_id", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def shard_of(doc_id: Column, total: Column, shards: int) -> Column:
    """Contiguous slices of total // shards documents; the last takes the rest."""
    return F.least((doc_id / F.greatest(F.lit(1), F.floor(total / shards))).cast("long"), F.lit(shards - 1))


def with_shards(docs: DataFrame, shards: int = 4) -> DataFrame:
    total = docs.count()
    return docs.withColumn("shard", shard_of(F.col("doc_id"), F.lit(total), shards))


def shard_catalog(sharded: DataFrame) -> DataFrame:
    """(term, shard): which shards a term occurs in."""
    return sharded.select("term", "shard").distinct()


def tfidf(tf: DataFrame, terms: list[str], n_docs: int) -> DataFrame:
    """(doc_id, score): the sum of tf * ln(N / df) over the terms."""
    chosen = tf.where(F.col("term").isin(*terms))
    df = chosen.groupBy("term").agg(F.count("*").alias("df"))  # a row a term asked for
    return chosen.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("score"))


def bm25(tf: DataFrame, terms: list[str], n_docs: int, k1: float = 1.2, b: float = 0.75, lengths: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): Okapi BM25 over the terms; a document's length, lengths(doc_id, len), is the sum of its term
    frequencies, worked out of tf unless it is given."""
    lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("len")) if lengths is None else lengths
    mean = float(lengths.agg(F.avg("len")).first()[0] or 1.0)
    chosen = tf.where(F.col("term").isin(*terms))
    df = chosen.groupBy("term").agg(F.count("*").alias("df"))  # a row a term asked for
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean)))
    return chosen.join(F.broadcast(df), "term").join(lengths, "doc_id").groupBy("doc_id").agg(F.sum(idf * part).alias("score"))
