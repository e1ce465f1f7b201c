"""Index statistics, invariant checks, and summaries of benchmark samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def posting_length_stats(df: DataFrame) -> DataFrame:
    """min, upper median, max and mean of the lists' lengths; the median comes from counts by length, not a collected list."""
    by_length = df.groupBy("df").agg(F.count("*").alias("n"))
    ordered = Window.orderBy("df")  # one row for each distinct length
    ranked = by_length.select("df", "n", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("df")))
    return ranked.agg(F.min("df").alias("min_df"), middle.alias("median_df"), F.max("df").alias("max_df"), F.round(F.sum(F.col("df") * F.col("n")) / F.sum("n"), 6).alias("mean_df"))


def rare_term_share(df: DataFrame, most: int = 3) -> DataFrame:
    share = F.avg(F.when(F.col("df") <= most, 1.0).otherwise(0.0)) * 100
    return df.agg(F.round(share, 6).alias("rare_pct"), (share >= 50).alias("passed"))


def high_frequency_terms(df: DataFrame, n_docs: int) -> DataFrame:
    return df.where(F.col("df") > n_docs // 2)


def mid_frequency_terms(df: DataFrame, low: int = 3, high: int = 20, k: int = 2) -> DataFrame:
    """The k most frequent of the terms with low to high documents; ties in the order of terms."""
    return df.where(F.col("df").between(low, high)).orderBy(F.desc("df"), "term").limit(k)


def sample_stats(samples: DataFrame, value: Column, keys: list[str], name: str = "ms") -> DataFrame:
    """mean, median, p95, p99, min and max by keys: exact percentiles with linear interpolation, rounded to 4."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = samples.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p.alias("p"), F.min(value).alias("low"), F.max(value).alias("high"))
    cut = {"mean": F.col("mean"), "median": F.col("p")[0], "p95": F.col("p")[1], "p99": F.col("p")[2], "min": F.col("low"), "max": F.col("high")}
    return out.select(*keys, "n", *[F.round(c, 4).alias(f"{k}_{name}") for k, c in cut.items()])


def posting_invariants(lists: DataFrame, n_docs: int) -> DataFrame:
    """Counts of lists that break each rule: sorted, without repeats, no negative ids, ids below n_docs, df their length."""
    ids = F.col("doc_ids")
    bad = {"unsorted": ids != F.array_sort(ids), "repeated": F.size(ids) != F.size(F.array_distinct(ids)), "negative": F.array_min(ids) < 0, "too_large": F.array_max(ids) >= n_docs, "df_mismatch": F.size(ids) != F.col("df")}
    return lists.agg(*[F.count_if(test).alias(name) for name, test in bad.items()])


def against_first(rows: DataFrame, metric: str, phase: str, value: str) -> DataFrame:
    """(metric, phase, value, delta_pct, speedup): each phase against the metric's first; 0 where that can't be said."""
    w = Window.partitionBy(metric).orderBy(phase).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(value).over(w)
    out = rows.withColumn("_b", base)
    delta = F.when(F.col("_b") != 0, (F.col(value) - F.col("_b")) / F.col("_b") * 100).otherwise(0.0)
    speedup = F.when(F.col(value) != 0, F.col("_b") / F.col(value)).otherwise(0.0)
    return out.select(metric, phase, value, F.round(delta, 4).alias("delta_pct"), F.round(speedup, 4).alias("speedup"))


def cross_phase(rows: DataFrame, metric: str, phase: str, value: str, phases: list[int]) -> DataFrame:
    """(metric, phase_1, phase_2, ..., delta_pct): a column for each of the phases, and the last against the first; null
    where a phase has no value."""
    wide = rows.groupBy(metric).pivot(phase, phases).agg(F.first(value))
    first, last = F.col(str(phases[0])), F.col(str(phases[-1]))
    return wide.select(metric, *[F.col(str(k)).alias(f"phase_{k}") for k in phases], F.round(F.when(first != 0, (last - first) / first * 100).when(first == 0, 0.0), 4).alias("delta_pct"))
