"""Mixing sources to target weights: fixed-length blocks, multinomial draws per shard, permuted block indices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm.common import mix as mix_hash
from lexmill.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources in code-point order, null last, take the weights in turn. Targets are proportional to the weights and sum
    to share * all sizes; a target stops at most * its source's size and the excess is shared again by weight. In
    order of most * size / weight the stopped sources are a prefix: with the first k stopped, the others get
    (total - sum of k stops) / (sum of their weights) per weight, so k is where that no longer exceeds the next ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    rows = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double").alias("w"))
    rows = rows.withColumn("stop", most * F.col("source_size"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", share * F.sum("source_size").over(everything))
    rows = rows.withColumn("rate", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("w").over(after))
    stops = F.col("stop") <= F.col("rate") * F.col("w")
    rate = F.max(F.when(~stops, F.col("rate"))).over(everything)  # of those that don't stop, the first has the most
    rows = rows.withColumn("level", rate)
    return rows.select("source", "source_size", F.coalesce(F.least("stop", F.col("level") * F.col("w")), "stop").alias("target"))


def _draws(seed: int, per_shard: int, shards: int, slots: int, p: np.ndarray):
    """For mapInPandas: residual multinomial counts of each source in each shard (whole parts fixed, the rest drawn)."""

    def draw(frames):
        for frame in frames:
            out = []
            for shard in frame["shard"].tolist():
                k = min(per_shard, slots - shard * per_shard)
                exact = p * k
                base = np.floor(exact + 1e-9).astype(np.int64)
                left = int(k - base.sum())
                rest = np.clip(exact - base, 0, None)
                if left > 0:
                    base += np.random.default_rng([seed, shard]).multinomial(left, rest / rest.sum() if rest.sum() > 0 else p)
                at = np.flatnonzero(base)
                out.append(pd.DataFrame({"shard": shard, "s": at, "n": base[at]}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "s": [], "n": []})

    return draw


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row a pseudorandom permutation of 0..n-1 chosen by key, at i: a Feistel network with cycle walking.

    The network permutes 0..4**b - 1, the least such range that holds n; what lands outside goes through it again, so
    that rows of one key and n never meet. Less than four passes are needed on average.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo, n = i.astype(np.uint64), np.ones(len(i), bool), n.astype(np.uint64)
    while todo.any():
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (mix_hash(right * np.uint64(2 * turn + 3) + k + np.uint64(turn)) & m)
        out[todo] = (left << h) | right
        todo = out >= n
    return out.astype(np.int64)


def _slots(seed: int, epochs: int):
    """For mapInPandas: each (shard, s, n, first, blocks) row becomes n slots (s, shard, slot, block)."""

    def expand(frames):
        for frame in frames:
            for part in np.array_split(frame, max(1, int(frame["n"].sum()) // 500_000)) if len(frame) else []:
                n = part["n"].to_numpy()
                wide = part.loc[part.index.repeat(n)]
                slot = np.arange(len(wide)) - np.repeat(np.cumsum(n) - n, n)
                j, blocks = wide["first"].to_numpy() + slot, wide["blocks"].to_numpy()
                epoch, s = j // blocks, wide["s"].to_numpy()
                key = mix_hash((s.astype(np.uint64) << np.uint64(32)) + epoch.astype(np.uint64) * np.uint64(7919) + np.uint64(seed))
                out = pd.DataFrame({"s": s, "shard": wide["shard"].to_numpy(), "slot": slot, "block": permuted(j % blocks, blocks, key)})
                yield out[epoch < epochs]

    return expand


def before(rows: DataFrame, key: str, order: str, value: str, group: int = 1 << 12) -> DataFrame:
    """rows with `from`: the sum of value over the rows of the same key with a lesser number in order.

    Numbers are summed in groups of `group`, then groups, so that one key is many tasks' work.
    """
    rows = rows.withColumn("_group", F.floor(F.col(order) / group))
    sums = rows.groupBy(key, "_group").agg(F.sum(value).alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy(key).orderBy("_group")) - F.col("_n")
    inside = F.sum(value).over(Window.partitionBy(key, "_group").orderBy(order)) - F.col(value)
    return rows.join(sums.select(key, "_group", so_far.alias("_from")), [key, "_group"]).withColumn("from", F.col("_from") + inside).drop("_group", "_from")


class Mix:
    """A mix of docs(doc_id, source, text): its rows, sources, block pieces and slots, as DataFrames.

    Words of a source form a stream (documents in an order hashed from id and text), cut into blocks of `block` words;
    only a source's last block is shorter. A source's share of the slots follows its target; its counts by shard are
    drawn as residual multinomials with a generator seeded by shard, its slots are numbered by a running sum over the
    shards, and slot j takes block perm(j mod blocks) of epoch j div blocks. Slots beyond `most` (whole) epochs stay
    empty, so that no document is taken more than `most` times. All of it is a function of data and seed: reruns agree.

    Offsets of documents come from running sums over groups of hashed buckets of a source, over buckets and within them;
    a source has a bucket for each bucket_rows of its rows, so that one with a third of all rows is never one task's
    work. Slots are dealt out by (s, shard); blocks and slots join on (s, block), where no key is hot. One row a source
    is all that the driver sees. Texts of any length count as a whole; an empty table gives an empty mix.

    null text has no words; null source is a source of its own, the last; equal rows count each for itself; a null
    doc_id is no different from others; columns other than doc_id, source and text are ignored.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, per_shard: int = 4096, seed: int = 11, bucket_rows: int = 500):
        spark = docs.sparkSession
        #: (row, doc_id, source, size, h): one for each row of docs; row is an id that holds once it is stored.
        self.rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")))
        by_source = stored(self.rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / bucket_rows).alias("buckets")))
        sources = targets(by_source.select("source", "source_size"), weights, share, most)
        sources = sources.join(by_source.select(F.col("source").alias("same"), "buckets"), F.col("source").eqNullSafe(F.col("same"))).drop("same")
        #: (source, source_size, target, buckets, s): s numbers the sources.
        self.sources = stored(sources.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).coalesce(1))
        named = self.with_source(self.rows).withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("buckets")))
        sums = before(named.groupBy("s", "bucket").agg(F.sum("size").alias("n")), "s", "bucket", "n").select("s", "bucket", "from")
        inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
        placed = named.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["s", "bucket"]).withColumn("at", F.col("at") + F.col("from"))
        pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
        start = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
        #: (s, block, row, start, n_words): one for each block that a document has words in.
        self.pieces = pieces.select("s", "block", "row", start.cast("long").alias("start"), (F.least(F.col("size"), (F.col("block") + 1) * block - F.col("at")) - start).cast("long").alias("n_words"))

        plan = [(r.s, -(-r.source_size // block), r.target * -(-r.source_size // block) / r.source_size) for r in self.sources.where("source_size > 0").orderBy("s").collect()]
        wanted = sum(x[2] for x in plan)
        slots = round(wanted)
        shards = -(-slots // per_shard)
        p = np.zeros(max((x[0] for x in plan), default=0) + 1)
        for s, _, n in plan:
            p[s] = n / wanted
        drawn = spark.range(shards).select(F.col("id").alias("shard")).mapInPandas(_draws(seed, per_shard, shards, slots, p), "shard long, s int, n long")
        drawn = before(drawn, "s", "shard", "n").withColumnRenamed("from", "first")
        blocks = self.sources.select("s", F.ceil(F.col("source_size") / block).alias("blocks"))
        drawn = drawn.join(blocks, "s").select("shard", "s", "n", "first", "blocks").repartition("s", "shard")
        #: (s, shard, slot, block)
        self.slots = drawn.mapInPandas(_slots(seed, most), "s int, shard long, slot long, block long")

    def with_source(self, rows: DataFrame) -> DataFrame:
        """rows(source, ...) with s, source_size, target and buckets."""
        named = self.sources.withColumnRenamed("source", "named")
        return rows.join(named, rows.source.eqNullSafe(named.named), "left").drop("named")

    def placed(self) -> DataFrame:
        """(shard, slot, s, block, row, start, n_words): the pieces of the block in each slot.

        Both sides come from few rows that become many, which Spark's size estimates don't see: without the hint it
        broadcasts all slots once their counts by shard, thousands of times fewer, are under its threshold.
        """
        return self.slots.hint("merge").join(self.pieces, ["s", "block"])

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of each row of docs."""
        words = self.placed().groupBy("row").agg(F.sum("n_words").alias("taken"))
        return self.with_source(self.rows).join(words, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")

    def texts(self, docs: DataFrame) -> DataFrame:
        """(shard, slot, source, block, start, doc_id, words): the mix itself, words as arrays, pieces by block and row."""
        text = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text").dropDuplicates(["doc_id", "h"])
        rows = self.rows.join(text, self.rows.doc_id.eqNullSafe(text.doc_id) & (self.rows.h == text.h)).select("row", self.rows.doc_id, "source", "text")
        words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("start") + 1).cast("int"), F.col("n_words").cast("int"))
        return self.placed().join(rows, "row").select("shard", "slot", "source", "block", "row", "start", "doc_id", words.alias("words"))
