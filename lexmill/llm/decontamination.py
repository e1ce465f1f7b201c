"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import blocks_of, grams, stored, utf8, words

N = 3  #: words of a seed
MATCH, MISMATCH, GAP = 2, -1, -1


def local_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two hash sequences, and the passage's first and last + 1 positions in it.

    Row by row over the item; the run of gaps within a row is a running maximum, so that each row is a few array
    operations.
    """
    n = len(passage)
    ramp = np.arange(n + 1, dtype=np.int64) * -GAP
    above, since_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = above[1:] + GAP
        here, since = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = np.maximum(diagonal, up)
        here[1:] = np.maximum(take, 0)
        since[1:] = np.where(take > 0, np.where(diagonal >= up, since_above[:-1], since_above[1:]), since[1:])
        lifted = here + ramp
        top = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        here, since = top - ramp, since[origin]
        k = int(here.argmax())
        if here[k] > best[0]:
            best = (int(here[k]), int(since[k]), k)
        above, since_above = here, since
    return best


def seed_counts(column: pa.Array, seeds: np.ndarray) -> np.ndarray:
    """How often each of the sorted seeds occurs in the texts of a column."""
    out = np.zeros(len(seeds), np.int64)
    h, at, _ = hits(column, seeds)
    np.add.at(out, h, 1)
    return out


def hits(column: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(index of the seed, word position) of each seed in a column's texts, and the words themselves."""
    data, offsets = utf8(column)
    h, starts, ends, rows = words(data, offsets)
    g = grams(h, N)
    ok = np.ones(len(g), bool)
    for k in range(1, N):  # grams that run over the end of a row
        at = rows[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    near = np.zeros(1 << 20, bool)  # most grams are settled by their first 20 bits
    near[(seeds >> np.uint64(44)).astype(np.int64)] = True
    found = np.flatnonzero(near[(g >> np.uint64(44)).astype(np.int64)] & ok)
    where = np.searchsorted(seeds, g[found])
    where[where == len(seeds)] = 0
    same = seeds[where] == g[found] if len(seeds) else np.zeros(len(found), bool)
    return where[same], found[same], (h, rows)


class Items:
    """Test items as word hashes with their seeds: gram, item and place, sorted by gram."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, rows = [], [], []
        #: items of fewer than N words: their hashes -> item_ids
        self.short: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in items:
            h, *_ = words(*utf8(pa.array([text])))
            if len(h) < N:
                if len(h):
                    self.short.setdefault(tuple(h.tolist()), []).append(item_id)
                continue
            self.ids.append(item_id)
            self.words.append(h)
            rows += [(int(g), len(self.ids) - 1, k) for k, g in enumerate(grams(h, N))]
        rows.sort()
        self.gram = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        self.seeds = np.unique(self.gram)

    def keep_rare(self, counts: np.ndarray, share: float) -> None:
        """Keeps of each item the `share` of its grams that the corpus has least (8 at least)."""
        n = counts[np.searchsorted(self.seeds, self.gram)]
        order = np.lexsort((self.place, n, self.item))
        size = np.bincount(self.item, minlength=len(self.ids))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        keep = np.zeros(len(self.gram), bool)
        keep[order[rank < np.maximum(8, np.ceil(share * size))[self.item[order]]]] = True
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]
        self.seeds = np.unique(self.gram)

    def candidates(self, doc: np.ndarray, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Distinct (row, item, start of the passage // half an item) of seed hits at word positions of rows."""
        first = np.searchsorted(self.gram, gram, "left")
        n = np.searchsorted(self.gram, gram, "right") - first
        take = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[take]
        length = np.array([len(w) for w in self.words], np.int64)[item] if len(item) else np.zeros(0, np.int64)
        start = np.repeat(at, n) - self.place[take]
        return np.unique(np.stack((np.repeat(doc, n), item, start // np.maximum(1, length // 2)), 1), axis=0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, rare: float = 0.75, group_items: int = 5000) -> DataFrame:
    """(doc_id, item_id, score, start, end, text_hash) of each document and test item of which it holds a copy.

    Seeds are word N-grams (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) of the items; counts over the whole corpus
    choose the `rare` share of each item's. Where a seed occurs, the passage around it (the item's length, and half of
    it on either side) is aligned with the item; score is the best alignment's share of a perfect one, and of a
    document and item the best passage counts, if it reaches `threshold`. Items of fewer than N words are aligned
    nowhere, unless a document's whole text is the item.

    The benchmark is a small table next to the corpus; it reaches tasks in groups of `group_items` items, one scan of
    the corpus each, so memory is bounded whatever its size. Work is row-local: a passage that a third of all documents
    hold costs each of them one alignment. null and empty texts hold nothing, null doc_ids are kept as such, equal rows
    yield equal rows, other columns are ignored.
    """
    spark = docs.sparkSession
    docs, out = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), None
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text_hash", T.LongType())])
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    group: list[tuple[int, str]] = []
    for r in rows.toLocalIterator():
        group.append((r.item_id, r.text))
        if len(group) == group_items:
            part, group = _find(spark, docs, Items(group), threshold, rare, schema), []
            out = part if out is None else out.union(part)
    if group or out is None:
        part = _find(spark, docs, Items(group), threshold, rare, schema)
        out = part if out is None else out.union(part)
    return out


def _find(spark, docs: DataFrame, items: Items, threshold: float, rare: float, schema: T.StructType) -> DataFrame:
    seeds = spark.sparkContext.broadcast(items.seeds)

    def count(batches):
        total = np.zeros(len(seeds.value), np.int64)
        for batch in batches:
            for part in blocks_of(batch, "text"):
                total += seed_counts(part.column("text"), seeds.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["seed", "n"])

    counts = np.zeros(len(items.seeds), np.int64)
    got = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("seed").to_numpy()] = got.column("n").to_numpy()
    items.keep_rare(counts, rare)
    held = spark.sparkContext.broadcast(items)

    def work(batches):
        items = held.value
        for batch in batches:
            for part in blocks_of(batch, "text"):
                seed, at, (h, rows) = hits(part.column("text"), items.seeds)
                row = np.searchsorted(rows, at, "right") - 1
                found = items.candidates(row, at - rows[row], items.seeds[seed]) if len(at) else np.zeros((0, 3), np.int64)
                short: list[tuple[int, int, float, int, int]] = []
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for row, item, step in found.tolist():
                    target = items.words[item]
                    m, whole = len(target), h[rows[row] : rows[row + 1]]
                    half = max(1, m // 2)
                    a, b = max(0, step * half - half), min(len(whole), step * half + half + m + half)
                    score, first, last = local_alignment(target, whole[a:b])
                    value = (score / (MATCH * m), a + first, a + last)
                    if value[0] >= threshold and value > best.get((row, item), (0.0, 0, 0)):
                        best[row, item] = value
                for row in np.flatnonzero(np.diff(rows) < N).tolist() if items.short else ():
                    for item_id in items.short.get(tuple(h[rows[row] : rows[row + 1]].tolist()), ()):
                        short.append((row, item_id, 1.0, 0, int(rows[row + 1] - rows[row])))
                keys = sorted(best)
                leaks = [(k[0], items.ids[k[1]], *best[k]) for k in keys] + short
                owner = pa.array([x[0] for x in leaks], pa.int64())
                columns = [part.column("doc_id").take(owner)]
                columns += [pa.array([x[j + 1] for x in leaks], kind) for j, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, part.column("text_hash").take(owner)], names=schema.fieldNames())

    return docs.mapInArrow(work, schema)
