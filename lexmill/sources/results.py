"""Benchmark results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def latest_results(files: DataFrame) -> DataFrame:
    """Of (kind, name, ...) rows the one with the greatest name of each kind."""
    rest = [c for c in files.columns if c != "kind"]
    return files.groupBy("kind").agg(F.max_by(F.struct(*rest), "name").alias("r")).select("kind", *[F.col(f"r.{c}").alias(c) for c in rest])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The newest JSON document of each kind in a folder; a kind is a file's name without its date."""
    docs = spark.read.option("multiLine", True).json(path).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return latest_results(docs.withColumn("kind", F.regexp_replace("name", r"_?\d{8}_\d{6}\.json$", "")))
