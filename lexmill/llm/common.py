"""What the operators share: tables, materialised steps and vectorised hashing of words."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.scratch import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, name: str, value):
    """Within it, a setting of the session has another value."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here and survives lost executors.

    The shuffle files of the write are deleted with its end, so that only stored steps take disk space.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once no later plan reads it."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def arrow_rows(spark: SparkSession, rows: int):
    """Within it, Arrow batches to Python have so many rows at most: for rows that hold whole arrays."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def within(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is counted to have no more than so many rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(doc_id: str = "doc_id"):
    """The fold 0 to 3 of a document; 2 is held out. A null doc_id is in fold -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(-1))


# --- hashing of words over Arrow buffers ---------------------------------------------------------

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, kept at the largest length asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=np.uint64))
        return cls.up, cls.down


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's rows, one after another, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of [^\\x20\\x09-\\x0D] in each row, their byte starts and ends, and the rows' word offsets."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:n] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & np.concatenate((first[1:n] | ~inside[1:], [True]))) + 1
    up, down = _Powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data] if lower else data] * up[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n hashes in a row (over all rows; the caller leaves out those that cross rows)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += h[k : k + m] * STEP[k % 64] * np.uint64(2 * (k // 64) + 1)
    return mix(out)


def sequence_hash(h: np.ndarray) -> int:
    """A signed 64-bit hash of hashes in their order."""
    up, _ = _Powers.of(len(h) + 1)
    return int(mix((h * up[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))).view(np.int64)[0])


def blocks_of(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Slices of a batch whose texts (or binary values) have about `most` bytes each, at least one row; bounds what numpy holds."""
    at = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = at[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(at, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
