"""The compact binary index file, INVI_100: export from posting lists and import into a table.

Little-endian: the magic, the number of terms (4 bytes), for each ascending term its length (2), its number of documents
(4), its UTF-8 bytes and its coded gaps; last a CRC-32 of all before.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexmill.functions.codec import packed, sums, unpacked

MAGIC = b"INVI_100"
AT_ONCE = 1 << 18  #: numbers that an import gives back together
ENTRIES = 1 << 20  #: bytes of entries, about, that reach the driver together


class BadIndex(ValueError):
    """Not a readable index file."""


def _entries(lists: DataFrame) -> DataFrame:
    """(n, body): entries of n ascending terms one after another, coded by tasks, in the order of terms."""

    def run(batches):
        for batch in batches:
            names, held = batch.column("term").to_pylist(), batch.column("doc_ids")
            bounds = held.offsets.to_numpy().astype(np.int64)
            start = 0
            while start < len(names):  # some lists at a time
                stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + ENTRIES, side="right")) - 1)
                yield from coded(names[start:stop], held.slice(start, stop - start))
                start = stop

    def coded(names, held):
        ids = held.flatten().to_numpy(zero_copy_only=False)
        bounds = held.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        gap = ids.copy()
        gap[1:] -= ids[:-1]
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        gap[first] = ids[first]
        if (gap < 0).any():
            raise ValueError(f"a negative gap: {gap.min()}")
        data, ends = packed(gap)
        data, at = data.tobytes(), np.concatenate(([0], ends))[bounds]
        out, n, size = [], 0, 0
        for k, name in enumerate(names):
            term, count = name.encode("utf-8"), int(bounds[k + 1] - bounds[k])
            if len(term) > 0xFFFF:
                raise ValueError(f"a term of {len(term)} bytes")
            if count > 0xFFFFFFFF:
                raise ValueError(f"{count} documents for {name}")
            out += [struct.pack("<HI", len(term), count), term, data[at[k] : at[k + 1]]]
            n, size = n + 1, size + 6 + len(term) + int(at[k + 1] - at[k])
            if size >= ENTRIES or k == len(names) - 1:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([b"".join(out)], pa.binary())], ["n", "body"])
                out, n, size = [], 0, 0

    return lists.select("term", "doc_ids").orderBy("term").mapInArrow(run, "n long, body binary")


class _File:
    """An index file that is written entry by entry; its count and its checksum come with its end."""

    def __init__(self, path: str):
        self.path, self.terms, self.size = path, 0, 12
        self.file = open(path, "w+b")
        self.file.write(MAGIC + bytes(4))

    def put(self, n: int, body: bytes) -> None:
        self.terms += n
        self.size += self.file.write(body)

    def end(self) -> int:
        self.file.seek(8)
        self.file.write(struct.pack("<I", self.terms))
        self.file.seek(0)
        crc = 0
        while part := self.file.read(1 << 20):
            crc = zlib.crc32(part, crc)
        self.size += self.file.write(struct.pack("<I", crc))
        self.file.close()
        return self.size


def _written(lists: DataFrame, path: Callable[[int], str], most: float, ended: Callable[[str], None] | None = None) -> int:
    file, files, size = _File(path(0)), 1, 0
    try:
        for row in _entries(lists).toLocalIterator():
            if file.terms and file.size + len(row.body) > most:
                size += file.end()
                if ended:
                    ended(file.path)
                file, files = _File(path(files)), files + 1
            file.put(row.n, bytes(row.body))
        size += file.end()
        if ended:
            ended(file.path)
    except Exception as error:  # a task's ValueError comes in one of Spark's or of the gateway's
        if "ValueError: " in str(error):
            raise ValueError(str(error).split("ValueError: ")[1].split("\n")[0]) from error
        raise
    finally:
        file.file.close()
    return size


def export_index(lists: DataFrame, path: str) -> int:
    """Writes (term, doc_ids) as one file; returns its size.

    The file is one sequential artefact of the driver, which holds about ENTRIES bytes of it, or a partition of coded
    entries, at a time; tasks code. ValueError for a term of over 65,535 bytes or a list of 2**32 documents or more.
    """
    return _written(lists, lambda _: path, float("inf"))


def export_files(lists: DataFrame, folder: str, most: int = 1 << 23, ended: Callable[[str], None] | None = None) -> int:
    """Writes (term, doc_ids) as whole index files of about `most` bytes (or a single run of entries), each with terms after
    those of the one before; returns their size together. ended(path) is called with each file that is whole.

    An import reads a file in one task, so that it is the files' size, not the index's, that a task holds.
    """
    return _written(lists, lambda k: os.path.join(folder, f"part-{k:06d}.bin"), most, ended)


def _parsed(data: bytes, verify: bool = False) -> Iterator[tuple[str, int, int, int]]:
    """(term, declared count, start and end of its payload) of each term of a file, one after another."""
    if len(data) <= 18:
        return
    if data[:8] != MAGIC:
        raise BadIndex("a wrong magic")
    at, whole = 12, np.frombuffer(data, np.uint8)
    for _ in range(struct.unpack_from("<I", data, 8)[0]):
        if at + 6 > len(data):
            raise BadIndex("the file is cut off")
        size, count = struct.unpack_from("<HI", data, at)
        term, start = data[at + 6 : at + 6 + size].decode("utf-8"), at + 6 + size
        at, left = start, count
        while left and at < len(data):  # as many bytes as numbers are left, at least
            part = whole[at : at + left]
            at += len(part)
            left -= int(np.count_nonzero(part >= 128)) if len(part) > 8 else sum(x >= 128 for x in data[at - len(part) : at])
        if left:
            raise BadIndex(f"the list of {term} is cut off")
        yield term, count, start, at
    if verify and struct.unpack_from("<I", data, at)[0] != zlib.crc32(memoryview(data)[:at]):
        raise BadIndex("a wrong checksum")


def parse_index(data: bytes, verify: bool = False) -> list[tuple[str, int, bytes]]:
    """(term, declared count, payload) of each term. Files of 18 bytes or less are empty indexes, whatever they hold; a
    missing checksum is accepted, and one is compared only if asked for."""
    return [(term, count, data[start:end]) for term, count, start, end in _parsed(data, verify)]


def import_index(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """(term, df, doc_ids) of the index files at a path that Spark reads.

    Each file is one task's work, and is held as it is; lists are decoded some at a time. See export_files().
    """

    def decoded(found, data):
        names, counts, begin, end = zip(*found)
        held = np.frombuffer(b"".join(data[x:y] for x, y in zip(begin, end)), np.uint8)
        bounds = np.concatenate(([0], np.cumsum(np.array(end) - np.array(begin)))).astype(np.int64)
        values, at = unpacked(held, bounds)
        ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sums(values, at), pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), ids], ["term", "df", "doc_ids"])

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                data, found, numbers = content.as_py(), [], 0
                for entry in _parsed(data, verify):
                    found.append(entry)
                    numbers += entry[1] + 1
                    if numbers >= AT_ONCE:
                        yield decoded(found, data)
                        found, numbers = [], 0
                if found:
                    yield decoded(found, data)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "term string, df long, doc_ids array<long>")
