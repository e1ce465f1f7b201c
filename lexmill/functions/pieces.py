"""Sorted lists of numbers by term as rows of arrays, so that a number takes eight bytes of a shuffle and a term a few.

Tasks put together what comes together: a table sorted by term (a stored index) gives about a piece a term and task.
Nothing relies on that order; rows in another one only give more pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE = np.iinfo(np.int64).max  #: stands for null within arrays, and sorts last as it does in SQL
AT_ONCE = 1 << 18  #: numbers that are worked on, or given back, together


def numbers(column: pa.Array, null: int = NONE) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def codes(terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of terms by their first place (null has one too), and the terms."""
    found = terms.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values as lists that start at `at`."""
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(values)).astype(np.int32)), pa.array(values, pa.int64()))


def cut(index: DataFrame, block: int | None) -> DataFrame:
    """(term, block, ids): pieces of the ascending doc_ids of index(term, doc_id), of one block of ids each."""

    def run(batches):
        for batch in batches:
            term, names = codes(batch.column("term"))
            ids = numbers(batch.column("doc_id"))
            if ((term[1:] < term[:-1]) | ((term[1:] == term[:-1]) & (ids[1:] < ids[:-1]))).any():
                order = np.lexsort((ids, term))
                term, ids = term[order], ids[order]
            of = ids // block if block else np.zeros_like(ids)
            at = starts(term, of)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term[at])), pa.array(of[at]), lists(ids, at)], ["term", "block", "ids"])

    return index.select("term", "doc_id").mapInArrow(run, "term string, block long, ids array<long>")


def _some(batch: pa.RecordBatch, column: str):
    """Slices of a batch whose lists have about AT_ONCE numbers, at least a row."""
    ends = batch.column(column).offsets.to_numpy()[1:].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else int(batch.column(column).offsets[0].as_py())
        stop = max(start + 1, int(np.searchsorted(ends, base + AT_ONCE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def groups(batches):
    """Of sorted pieces (term, block, ids): (names, term, block, at, ids) of whole (term, block) groups at a time, where term
    and block say of each group what it is, and at where its sorted ids start."""
    held: list[pa.RecordBatch] = []

    def made(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        column = table.column("ids").combine_chunks() if table.num_rows else None
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        names_of = table.column("term").combine_chunks()
        term, names = codes(names_of.chunk(0) if isinstance(names_of, pa.ChunkedArray) else names_of)
        block = table.column("block").to_numpy()
        ids = column.flatten().to_numpy(zero_copy_only=False)
        at = column.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        first = starts(term, block)
        where = at[first]
        group = np.repeat(np.arange(len(first)), np.diff(np.append(where, len(ids))))
        if ((group[1:] == group[:-1]) & (ids[1:] < ids[:-1])).any():
            ids = ids[np.lexsort((ids, group))]
        return names, term[first], block[first], where, ids

    for batch in batches:
        for some in _some(batch, "ids"):
            if held and (some.column("term")[0].as_py(), some.column("block")[0].as_py()) == (held[-1].column("term")[-1].as_py(), held[-1].column("block")[-1].as_py()):
                term, block = codes(some.column("term"))[0], some.column("block").to_numpy()
                at = starts(term, block)
                if len(at) == 1:  # all of it goes on with the group that is held
                    held.append(some)
                    continue
            elif held:
                yield made(held)
                held = []
            term, block = codes(some.column("term"))[0], some.column("block").to_numpy()
            last = int(starts(term, block)[-1])  # the last group may go on in what comes next
            if last:
                yield made([*held, some.slice(0, last)])
                held = []
            held.append(some.slice(last))
    if held:
        yield made(held)


def placed(pieces: DataFrame, by: str) -> DataFrame:
    """All pieces of a term in one task, in order."""
    return pieces.repartition("term").sortWithinPartitions("term", by)


def merged(index: DataFrame, block: int | None = None) -> DataFrame:
    """(term, block, df, doc_ids) of index(term, doc_id): distinct ascending ids, and how many rows there were."""

    def run(batches):
        for names, term, of, at, ids in groups(batches):
            df = np.diff(np.append(at, len(ids)))
            group = np.repeat(np.arange(len(at)), df)
            kept = np.ones(len(ids), bool)
            kept[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
            kept &= ids != NONE
            begin = np.searchsorted(group[kept], np.arange(len(at)))
            blocks = pa.array(of, mask=of == NONE // block) if block else pa.array(of)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term)), blocks, pa.array(df), lists(ids[kept], begin)], ["term", "block", "df", "doc_ids"])

    return placed(cut(index, block), "block").mapInArrow(run, "term string, block long, df long, doc_ids array<long>")


def _given(names: pa.Array, term: np.ndarray, **columns: np.ndarray):
    """Batches of rows: a term's number in names, and columns in which NONE is null."""
    for start in range(0, len(term), AT_ONCE):
        part = slice(start, start + AT_ONCE)
        values = [pa.array(c[part], pa.int64(), mask=c[part] == NONE) for c in columns.values()]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(term[part])), *values], ["term", *columns])


def gaps(index: DataFrame, block: int) -> DataFrame:
    """(term, pos, gap) of index(term, doc_id): see lexmill.functions.codec."""

    def run(batches):
        before, count, last = None, 0, 0  # of the term before: its name, how many ids it has had, and the last one
        for names, term, _, at, ids in groups(batches):
            of = np.repeat(term, np.diff(np.append(at, len(ids))))
            at = starts(of)
            goes_on = before == (names[int(of[0])].as_py(),)
            base = np.zeros(len(at), np.int64)
            base[0] = count if goes_on else 0
            pos = np.arange(len(ids)) - np.repeat(at - base, np.diff(np.append(at, len(ids))))
            gap = ids.copy()
            gap[1:] -= ids[:-1]
            gap[at] = ids[at]
            if goes_on and ids[0] != NONE:
                gap[0] -= last
            gap[ids == NONE] = NONE
            before, count, last = (names[int(of[-1])].as_py(),), int(pos[-1]) + 1, int(ids[-1])
            yield from _given(names, of, pos=pos, gap=gap)

    return placed(cut(index, block), "block").mapInArrow(run, "term string, pos long, gap long")


def ungapped(coded: DataFrame, block: int) -> DataFrame:
    """(term, doc_id) of coded(term, pos, gap): see lexmill.functions.codec."""

    def run_up(batches):
        for batch in batches:
            term, names = codes(batch.column("term"))
            pos, gap = numbers(batch.column("pos")), numbers(batch.column("gap"))
            if ((term[1:] < term[:-1]) | ((term[1:] == term[:-1]) & (pos[1:] < pos[:-1]))).any():
                order = np.lexsort((pos, term))
                term, pos, gap = term[order], pos[order], gap[order]
            at = starts(term, pos - np.arange(len(pos)), pos // block)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term[at])), pa.array(pos[at]), lists(gap, at)], ["term", "first", "gaps"])

    def run(batches):
        before, total = None, 0  # the term before and the sum of its gaps
        for batch in batches:
            for some in _some(batch, "gaps"):
                term, names = codes(some.column("term"))
                column = some.column("gaps")
                of = np.repeat(term, np.diff(column.offsets.to_numpy()))
                gap = column.flatten().to_numpy(zero_copy_only=False)
                none = gap == NONE
                sums = np.cumsum(np.where(none, 0, gap))
                at = starts(of)
                base = np.where(at > 0, sums[at - 1], 0)
                if before == (names[int(of[0])].as_py(),):
                    base[0] -= total
                ids = sums - np.repeat(base, np.diff(np.append(at, len(of))))
                before, total = (names[int(of[-1])].as_py(),), int(ids[-1])
                ids[none] = NONE
                yield from _given(names, of, doc_id=ids)

    pieces = coded.select("term", "pos", "gap").mapInArrow(run_up, "term string, first long, gaps array<long>")
    return placed(pieces, "first").mapInArrow(run, "term string, doc_id long")
