"""Suffix-array dedup: suffixes kept by minimisers, sorted; neighbours compared, matches joined into whole passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import arrow_rows, blocks_of, forget, grams, stored, utf8, words

LEAST = 50  #: words of a passage
GRAM = 20  #: words of a gram; a passage of LEAST words has LEAST - GRAM + 1 of them, and the least one is retained
LAST = 2**63 - 1  #: stands for a null doc_id

def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` values in a row, in constant time a value."""
    n = len(x)
    fill = np.iinfo(np.uint64).max if best is np.minimum else 0
    grid = np.concatenate((x, np.full(-n % width, fill, np.uint64))).reshape(-1, width)
    ahead = best.accumulate(grid, 1).ravel()
    behind = best.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def minimisers(g: np.ndarray, window: int) -> np.ndarray:
    """Positions whose gram is the least of some `window` grams in a row; none if there are fewer grams."""
    if len(g) < window:
        return np.zeros(0, np.int64)
    edge = np.zeros(window - 1, np.uint64)
    # The greatest of the minima of all windows around a position equals its gram only if it is the least of one.
    return np.flatnonzero(_sliding(np.concatenate((edge, _sliding(g, window, np.minimum), edge)), window, np.maximum) == g)


def _retained(batches):
    """Rows (d, h, text) become (d, h, n, gs): words of the text, and the grams that its minimisers retain.

    gs is null for texts of fewer than LEAST words, and where the task had the same text shortly before.
    """
    seen: set[int] = set()
    for batch in batches:
        for part in blocks_of(batch, "text"):
            w, _, _, rows = words(*utf8(part.column("text")))
            found: list[np.ndarray | None] = []
            for k, h in enumerate(part.column("h").to_pylist()):
                if h in seen or rows[k + 1] - rows[k] < LEAST:
                    found.append(None)
                    continue
                if len(seen) >= 1 << 17:
                    seen.clear()
                seen.add(h)
                g = grams(w[rows[k] : rows[k + 1]], GRAM)
                found.append(g[minimisers(g, LEAST - GRAM + 1)].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("d"), part.column("h"), pa.array(np.diff(rows)), pa.array(found, pa.list_(pa.int64()))], names=["d", "h", "n", "gs"])


def _suffixes(batches):
    """Rows (d, h, text, gs) become (d, h, at, key): the places of the text whose next LEAST words have as their least gram
    one of gs, and 64-bit hashes of these words."""
    for batch in batches:
        for part in blocks_of(batch, "text"):
            w, _, _, rows = words(*utf8(part.column("text")))
            places, keys = [], []
            for k, gs in enumerate(part.column("gs")):
                own = w[rows[k] : rows[k + 1]]
                least = _sliding(grams(own, GRAM), LEAST - GRAM + 1, np.minimum)
                at = np.flatnonzero(np.isin(least.view(np.int64), gs.values.to_numpy(zero_copy_only=False)))
                places.append(at.astype(np.int32))
                keys.append(grams(own, LEAST)[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("d"), part.column("h"), pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], names=["d", "h", "at", "key"])


def _neighbours(batches):
    """Sorted rows (key, d, h, at) of a partition become (key, d, h, at, late, other, mark) where neighbours have one key.

    late says whether an earlier place has the key, other is the doc_id of the first place, or for that the second one's.
    Runs of the partition's first and last key may go on elsewhere: their places are there even if there is only one
    (other is null then), and each has another row, the mark, like that of its first place. Of a run no more than three
    places are held.
    """
    run = None  # key, first place, doc_id of the second, last place, whether the first place was given out
    edge = None  # the partition's first key

    def rows(*columns, mark=False):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), mark))], names=["key", "d", "h", "at", "late", "other", "mark"])

    def one(key, place, second, mark=False):
        return rows([key], [place[0]], [place[1]], [place[2]], [False], [second], mark=mark)

    for batch in batches:
        key, d, h, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "d", "h", "at"))
        fresh = np.ones(len(key), bool)  # equal rows are one
        fresh[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        if run and len(key):
            fresh[0] = (key[0], d[0], h[0], at[0]) != (run[0], *run[3])
        key, d, h, at = key[fresh], d[fresh], h[fresh], at[fresh]
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(starts, len(key)))
        late, told, other = np.ones(len(key), bool), np.repeat(size > 1, size), np.repeat(d[starts], size)
        late[starts] = False
        several = starts[size > 1]
        other[several] = d[several + 1]
        begins = [[key[k], (d[k], h[k], at[k]), d[k + 1] if n > 1 else None, None, n > 1] for k, n in ((starts[0], size[0]), (starts[-1], size[-1]))]
        if run and run[0] == key[0]:
            late[: size[0]], told[: size[0]], other[: size[0]] = True, True, run[1][0]
            if run[2] is None:
                run[2] = d[0]
            if not run[4]:
                yield one(*run[:3])
                run[4] = True
            begins[0] = run
        elif run and run[0] == edge:  # the first run ended with its batch
            if not run[4]:
                yield one(*run[:3])
            yield one(*run[:3], mark=True)
        edge = key[0] if edge is None else edge
        if len(starts) > 1 and begins[0][0] == edge:  # the first run ends here
            if not begins[0][4]:
                yield one(*begins[0][:3])
            yield one(*begins[0][:3], mark=True)
        yield rows(*(c[told] for c in (key, d, h, at, late, other)))
        run = begins[1] if len(starts) > 1 else begins[0]
        run[3] = (d[-1], h[-1], at[-1])
    if run:
        if not run[4]:
            yield one(*run[:3])
        yield one(*run[:3], mark=True)


def retained(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is kept of the texts of docs: (d, h, n, gs) of each row, (h, first, last, n, gs) of each text, and
    (d, h, at, key) of each text that may share a passage, with its retained suffixes. All are stored.

    d is the doc_id, the greatest long for null, and h a hash of the text. Words are runs of [^\\x20\\x09-\\x0D], A-Z
    lower-cased. A suffix is retained if the least gram of its first LEAST words occurs in another place too: every place
    of a passage has the same least gram, so none is lost. Equal texts count once.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("h"), "text").where("text is not null")
    read = stored(keyed.mapInArrow(_retained, "d long, h long, n long, gs array<long>"))
    texts = stored(read.groupBy("h").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.first("n").alias("n"), F.first("gs", True).alias("gs")).where(F.col("n") >= LEAST))
    kept = texts.select(F.col("first").alias("d"), "h", F.explode("gs").alias("g"))
    twice = stored(kept.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"))
    wanted = stored(kept.join(twice, "g").groupBy("d", "h").agg(F.collect_set("g").alias("gs")))
    with arrow_rows(docs.sparkSession, 256):
        suffixes = stored(keyed.join(wanted, ["d", "h"]).select("d", "h", "text", "gs").mapInArrow(_suffixes, "d long, h long, at array<int>, key array<long>"))
    forget(twice, wanted)
    return read, texts, suffixes


def matches(suffixes: DataFrame) -> DataFrame:
    """(d, h, at, late, other) of each place of a passage of LEAST words that occurs twice; see _neighbours. Stored.

    Suffixes are sorted by a 64-bit hash of their first LEAST words, then by place, and compared with their neighbours. The
    ranges of the sort may cut the places of a passage, so that one which a third of all documents share is many tasks'
    work; what they don't know of the first and last key of their range is put together from the marks, two a task.
    """
    rows = suffixes.select("d", "h", F.explode(F.arrays_zip("at", "key")).alias("s")).select(F.col("s.key").alias("key"), "d", "h", F.col("s.at").alias("at"))
    order = ["key", "d", "h", "at"]
    told = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "key long, d long, h long, at long, late boolean, other long, mark boolean"))
    here = F.struct("d", "h", "at")
    marks = told.where("mark").groupBy("key").agg(F.array_sort(F.collect_set(here)).alias("begins"), F.min_by("other", here).alias("second"))
    # The second place is the first one's neighbour in its range, or where that is alone, the first of the next range.
    marks = marks.select("key", F.col("begins")[0].alias("p"), F.coalesce("second", F.get("begins", F.lit(1))["d"]).alias("second"))
    known = told.where("not mark").join(F.broadcast(marks), "key", "left").withColumn("cut", F.col("p").isNotNull())
    late = F.when(F.col("cut"), here > F.col("p")).otherwise(F.col("late"))
    other = F.when(~F.col("cut"), F.col("other")).when(here > F.col("p"), F.col("p.d")).otherwise(F.col("second"))
    out = stored(known.select("d", "h", "at", late.alias("late"), other.alias("other")).where("other is not null"))
    forget(told)
    return out


def _spans(batches):
    """Rows (h, other, all, late) with starts of passages become (h, spans, later, other): spans joined where they meet."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        columns = []
        for c in ("all", "late"):
            out = []
            for starts in batch.column(c):
                x = np.sort(starts.values.to_numpy(zero_copy_only=False))
                new = np.flatnonzero(np.diff(x) > LEAST) + 1
                lows, highs = x[np.concatenate(([0], new))] if len(x) else x, x[np.concatenate((new - 1, [-1]))] + LEAST if len(x) else x
                out.append([{"start": a, "end": b} for a, b in zip(lows.tolist(), highs.tolist(), strict=True)])
            columns.append(pa.array(out, kind))
        yield pa.RecordBatch.from_arrays([batch.column("h"), *columns, batch.column("other")], names=["h", "spans", "later", "other"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_repeated, spans, later, partner) of the documents that share a passage of LEAST words or more.

    spans are the document's repeated word ranges [start, end), joined where they meet; n_repeated counts their words;
    later are those of them that an earlier place has too, which a deletion would take; partner is the least doc_id of
    those it shares one with (itself, if a passage recurs within it). Documents without such a passage have no row.
    Places are in the order of doc_id, then of a hash of the text, then of words.

    null texts and texts of fewer than LEAST words have none; an empty table gives an empty one. Equal rows are one
    document; of equal texts the one with the least doc_id is compared with others, the rest are repeated as a whole.
    null doc_ids come last and are told apart by text. Columns other than doc_id and text are ignored.
    """
    read, texts, suffixes = retained(docs)
    found = matches(suffixes)
    forget(suffixes)
    spans = "array<struct<start:bigint,end:bigint>>"
    by_text = found.groupBy("h").agg(F.collect_list("at").alias("all"), F.collect_list(F.when(F.col("late"), F.col("at"))).alias("late"), F.min("other").alias("other"))
    by_text = by_text.mapInArrow(_spans, f"h long, spans {spans}, later {spans}, other long")
    rows = read.select("d", "h").distinct()
    second = rows.join(texts.where("first < last").select("h", "first"), "h").where("d > first").groupBy("h").agg(F.min("d").alias("second"))
    info = texts.drop("gs").join(by_text, "h", "left").join(second, "h", "left").where("spans is not null or second is not null")
    info = stored(info)
    forget(found, texts)
    out = rows.join(info, "h")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    later = F.when(F.col("d") > F.col("first"), whole).otherwise(F.coalesce("later", F.array().cast(spans)))
    out = out.withColumn("later", later).withColumn("spans", F.when(F.col("second").isNotNull(), whole).otherwise(F.col("spans")))
    out = out.withColumn("other", F.least("other", F.when(F.col("d") > F.col("first"), F.col("first")).otherwise(F.col("second"))))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(real("d").alias("doc_id"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_repeated"), "spans", "later", real("other").alias("partner"))
