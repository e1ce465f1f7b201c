"""Text corpora and query files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_corpus(folder: str) -> list[str]:
    """Paths of the regular files of a folder (hidden and empty ones too, no sub-folders), sorted as strings."""
    return sorted(x.path for x in os.scandir(folder) if x.is_file())


def read_corpus(spark: SparkSession, folder: str, offset: int = 0, start: int = 0, stop: int | None = None) -> DataFrame:
    """(doc_id, path, text) of a slice of a local folder's files.

    Spark's file sources skip empty and hidden files, which must keep their ids here, so names are listed on the driver
    and contents are read by tasks. Invalid UTF-8 fails the job, as does a file that is gone.
    """
    files = [(offset + k, path) for k, path in enumerate(list_corpus(folder)[start:stop])]
    listed = spark.createDataFrame(files, "doc_id long, path string")

    def load(frames):
        for frame in frames:
            frame["text"] = [open(p, "rb").read().decode("utf-8") for p in frame["path"]]
            yield frame

    return listed.mapInPandas(load, "doc_id long, path string, text string")


def read_remote_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of a folder in any store that Spark reads; empty and hidden files are skipped, invalid UTF-8 fails."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.validate_utf8(F.col("content").cast("string")).alias("text"))


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) of a query file: lines that aren't blank or comments, trimmed."""
    lines = spark.read.text(path).select(F.trim("value").alias("query"))
    return lines.where("query <> '' and not startswith(query, '#')")


def query_list(path: str) -> list[str]:
    """The same on the driver; ValueError for a file without queries."""
    with open(path, encoding="utf-8") as file:
        found = [x.strip() for x in file if x.strip() and not x.strip().startswith("#")]
    if not found:
        raise ValueError(f"no queries in {path}")
    return found
