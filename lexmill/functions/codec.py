"""Delta and variable-byte coding: as Column expressions, and for single lists."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import pieces


def gaps(index: DataFrame, docs_a_block: int = 1 << 20) -> DataFrame:
    """(term, pos, gap): differences of a term's ascending doc_ids, the first from 0.

    Lists are shuffled as arrays, by blocks of doc_ids; a block starts from the count and the last doc_id of those before
    it. A null doc_id comes last and has no gap.
    """
    return pieces.gaps(index, docs_a_block)


def ungapped(coded: DataFrame, gaps_a_block: int = 1 << 20) -> DataFrame:
    """(term, doc_id) from (term, pos, gap): running sums within blocks of gaps, from the sum of the blocks before."""
    return pieces.ungapped(coded, gaps_a_block)


def gap_list(ids: Column) -> Column:
    """Gaps of an ascending array."""
    return F.transform(ids, lambda x, k: x - F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(ids, k - 1)))


def byte_count(gap: Column) -> Column:
    """Bytes of a non-negative number: seven bits each."""
    return sum((F.when(gap >= 1 << (7 * k), 1).otherwise(0) for k in range(1, 9)), F.lit(1)).cast("long")


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of numbers, low bits first, seven a byte, the high bit set on a number's last; and where each ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << (7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    left, at, place = values, ends - size, np.arange(len(values))
    while len(place):
        last = size[place] == 1
        out[at] = (left & 127) | np.where(last, 128, 0)
        on = ~last
        size[place] -= 1
        place, left, at = place[on], left[on] >> 7, at[on] + 1
    return out, ends


def unpacked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of coded bytes that are cut at bounds, and where each cut's numbers start; bytes without a last one go."""
    last = data >= 128
    new = np.ones(len(data), bool)
    new[1:] = last[:-1]
    new[bounds[:-1][bounds[:-1] < len(data)]] = True
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    shift = 7 * (np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data)))))
    values = np.add.reduceat((data & 127).astype(np.int64) << (shift & 63), first)
    whole = last[np.append(first[1:], len(data)) - 1]
    return values[whole], np.searchsorted(first[whole], bounds)


def _each(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists (a null one has none), and the bounds of each row's; nulls within lists go."""
    held = column.flatten()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    if held.null_count:
        valid = held.is_valid().to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(valid)))[bounds]
        held = held.drop_null()
    return held.cast(pa.int64()).to_numpy(zero_copy_only=False), bounds


def _lists(values: np.ndarray, bounds: np.ndarray, column: pa.Array) -> pa.Array:
    """Lists of values cut at bounds, null where the column is."""
    none = column.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, pa.int64()), mask=pa.array(none))


def _vbyte(column: pa.Array) -> pa.Array:
    values, bounds = _each(column)
    data, ends = packed(values)
    at = np.concatenate(([0], ends))[bounds].astype(np.int32)
    valid = pa.array(column.is_valid()) if column.null_count else None
    bitmap = None if valid is None else valid.buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(column), [bitmap, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = column.cast(pa.large_binary())
    offsets = np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, size.offset * 8)
    data = np.frombuffer(size.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _unvbyte(column: pa.Array) -> pa.Array:
    return _lists(*unpacked(*_bytes(column)), column)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Running sums within bounds."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds))


def _ungap(column: pa.Array) -> pa.Array:
    values, bounds = _each(column)
    return _lists(sums(values, bounds), bounds, column)


def vbyte(numbers: Column) -> Column:
    """An array of non-negative numbers as BINARY, low bits first; a batch of arrays is coded at once."""
    return F.arrow_udf(_vbyte, "binary")(numbers)


def unvbyte(payload: Column) -> Column:
    """The numbers of a coded BINARY."""
    return F.arrow_udf(_unvbyte, "array<bigint>")(payload)


def ungap_list(gaps: Column) -> Column:
    """The ascending array that has these gaps."""
    return F.arrow_udf(_ungap, "array<bigint>")(gaps)


def encode_list(ids: Iterable[int]) -> bytes:
    """Gaps of an ascending list, coded; ValueError for negative gaps."""
    out, last = bytearray(), 0
    for x in ids:
        gap, last = x - last, x
        if gap < 0:
            raise ValueError(f"a negative gap: {gap}")
        while gap > 127:
            out.append(gap & 127)
            gap >>= 7
        out.append(gap | 128)
    return bytes(out)


def decode_list(payload: bytes) -> list[int]:
    out, value, shift, total = [], 0, 0, 0
    for byte in payload:
        value |= (byte & 127) << shift
        shift += 7
        if byte & 128:
            total += value
            out.append(total)
            value = shift = 0
    return out
