"""Line dedup: winnowing over line hashes, positions joined, matches extended both ways, later repeated runs deleted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import forget, stored

LINE = "\n"
WORDS = 50  #: a run of so many words goes even if it has fewer lines than the window
WHOLE = 99  #: salt of the keys of whole documents with fewer lines than the window


def line_hashes(text: Column) -> Column:
    """64-bit hashes of the lines of a text; lines are what \\n sets apart, trimmed; null text has none."""
    return F.transform(F.split(text, LINE), lambda x: F.xxhash64(F.trim(x)))


def line_words(text: Column) -> Column:
    """Words ([^\\x20\\x09-\\x0D]+) of the lines of a text."""
    return F.transform(F.split(text, LINE), lambda x: F.regexp_count(x, F.lit("[^\\x20\\x09-\\x0D]+")))


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the minima of all windows of `window` hashes (the rightmost of equal ones); none of a shorter array."""
    n = len(hashes)
    if n < window:
        return np.arange(0)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)  # reversed: argmin takes the rightmost
    return np.unique(n - 1 - (np.arange(len(views)) + views.argmin(1)))


def run_keys(x: np.ndarray, starts: np.ndarray, lines: int) -> np.ndarray:
    """64-bit hashes of the runs of so many lines of x at starts."""
    key = np.full(len(starts), lines, np.int64)
    for k in range(lines):
        key = key * np.int64(-7046029254386353131) + (x[starts + k] ^ np.int64(0x2545F4914F6CDD1D)) * np.int64(0x5851F42D4C957F2D)
        key = key ^ (key >> np.int64(29))
    return key


def _fingerprints(window: int):
    """For mapInArrow: rows (d, h, hashes, n_words) become (key, d, h, at): runs of lines whose first place is looked for.

    These are the runs of `window` lines that hold a fingerprint, all shorter runs of WORDS words or more, and the whole
    of a document with fewer lines than the window.
    """

    def work(batches):
        for batch in batches:
            keys, places, counts = [], [], []
            for hashes, n_words in zip(batch.column("hashes"), batch.column("n_words"), strict=True):
                x = hashes.values.to_numpy(zero_copy_only=False).astype(np.int64)
                at = winnowed(x, window)
                starts = np.unique(at[:, None] - np.arange(window))
                starts = starts[(starts >= 0) & (starts <= len(x) - window)]
                runs = [(starts, run_keys(x, starts, window))]
                so_far = np.concatenate(([0], np.cumsum(n_words.values.to_numpy(zero_copy_only=False).astype(np.int64))))
                for lines in range(1, min(window - 1, len(x)) + 1):
                    starts = np.flatnonzero(so_far[lines:] - so_far[:-lines] >= WORDS)
                    runs.append((starts, run_keys(x, starts, lines)))
                if len(x) < window:
                    starts = np.zeros(1, np.int64)
                    runs.append((starts, run_keys(x, starts, len(x)) ^ np.int64(WHOLE)))
                keys += [k for _, k in runs]
                places += [p for p, _ in runs]
                counts.append(sum(len(p) for p, _ in runs))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([cat(keys), batch.column("d").take(owner), batch.column("h").take(owner), cat(places)], names=["key", "d", "h", "at"])

    return work


def extended(a: np.ndarray, b: np.ndarray, shift: int, least: int, n_words: np.ndarray) -> list[tuple[int, int]]:
    """Runs [start, end) of lines of a that equal those `shift` lines before them in b.

    They have at least `least` lines, or WORDS words by the n_words of a's lines, or are all of a and b.
    """
    first, last = max(0, shift), min(len(a), len(b) + shift)
    if last <= first:
        return []
    same = np.concatenate(([False], a[first:last] == b[first - shift : last - shift], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2]
    so_far = np.concatenate(([0], np.cumsum(n_words)))
    keep = (ends - starts >= least) | (so_far[ends + first] - so_far[starts + first] >= WORDS) | ((ends - starts == len(a)) & (len(a) == len(b)))
    return list(zip((starts[keep] + first).tolist(), (ends[keep] + first).tolist(), strict=True))


def _extend(least: int):
    """For mapInArrow: rows (d, h, shifts, a, b, n_words) become (d, h, start, end)."""

    def work(batches):
        for batch in batches:
            out = []
            as_array = lambda x: x.values.to_numpy(zero_copy_only=False)
            for d, h, shifts, a, b, n_words in zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), batch.column("shifts").to_pylist(), batch.column("a"), batch.column("b"), batch.column("n_words"), strict=True):
                a, b, n_words = as_array(a), as_array(b), as_array(n_words)
                for shift in shifts:
                    out += [(d, h, start, end) for start, end in extended(a, b, shift, least, n_words)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["d", "h", "start", "end"])

    return work


def repeated_runs(rows: DataFrame, window: int = 3) -> DataFrame:
    """(d, h, start, end): the runs of lines of rows(d, h, hashes, n_words) that an earlier place has too; (d, h) is unique.

    Every repeated run of `window` lines or more holds a winnowed fingerprint, at the same place in each copy. All runs
    of `window` lines that hold it point to the first place that has the whole run, by (d, h, line), so frequent lines
    in other company lead nowhere else. Matches are followed along the shift between both places, and runs of
    `window` lines or more are returned, as are shorter ones of WORDS words or more and whole short documents. First places come from a minimum that is pre-aggregated in each task, and
    every other place joins this one only: a run that a third of all documents share makes a row for each
    document, never pairs of them. Places within one document count too. The result is stored. Joins are merge joins at
    every size: the sizes of compressed steps, by which Spark would broadcast, say little of what they hold in memory.
    """
    prints = stored(rows.mapInArrow(_fingerprints(window), "key long, d long, h long, at long"))
    first = prints.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "at")).alias("p")).where("n > 1").drop("n")
    here = F.struct("d", "h", "at")
    matched = prints.join(first.hint("merge"), "key").where(here > F.col("p")).groupBy("d", "h", F.col("p.d").alias("d0"), F.col("p.h").alias("h0")).agg(F.collect_set((F.col("at") - F.col("p.at")).cast("int")).alias("shifts"))
    matched = stored(matched)
    forget(prints)
    later = rows.withColumnRenamed("hashes", "a").join(matched.hint("merge"), ["d", "h"])
    both = later.join(rows.select(F.col("d").alias("d0"), F.col("h").alias("h0"), F.col("hashes").alias("b")).hint("merge"), ["d0", "h0"])
    out = stored(both.select("d", "h", "shifts", "a", "b", "n_words").mapInArrow(_extend(window), "d long, h long, start long, end long").distinct())
    forget(matched)
    return out


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) with the repeated runs of lines deleted from text, and n_lines and n_removed added.

    A run of `window` or more lines (compared without spaces at their ends), or of WORDS words or more in fewer lines,
    goes from every place but the first, and so does a document of fewer lines that equals an earlier one, unless it has
    no words. Places are in the order of doc_id (null last), then of a hash of the text. Texts that lose nothing are unchanged to the byte; a
    text that loses all lines is ''. null texts stay null and empty ones empty. Equal rows are one document and have
    the same result. Other columns are kept; ones named n_lines or n_removed are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*kept, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_d"), F.xxhash64("text").alias("_h"))
    rows = stored(keyed.select(F.col("_d").alias("d"), F.col("_h").alias("h"), line_hashes(F.col("text")).alias("hashes"), line_words(F.col("text")).alias("n_words")).where((F.size("hashes") >= window) | F.exists("n_words", lambda n: n > 0)).dropDuplicates(["d", "h"]))
    found = repeated_runs(rows, window)
    forget(rows)
    runs = found.groupBy(F.col("d").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("start", "end")).alias("_runs"))
    lines = F.split("text", LINE)
    left = F.filter(lines, lambda x, i: ~F.exists("_runs", lambda r: (i >= r["start"]) & (i < r["end"])))
    out = keyed.join(runs.hint("merge"), ["_d", "_h"], "left").withColumn("_left", F.when(F.col("_runs").isNotNull(), left))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    n_removed = F.when(F.col("_left").isNull(), 0).otherwise(F.size(lines) - F.size("_left"))
    text = F.when(F.col("_left").isNull(), F.col("text")).otherwise(F.array_join("_left", LINE))
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in kept], n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
