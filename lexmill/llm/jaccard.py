"""N-gram Jaccard join: an exact metric-space join on distance 1 - Jaccard, by pivots, windows and recursion.

How the exact join stays near-linear.

* Regions. A set x of n shingles lacks at most floor(n / 4) of a set it links with, so under any order of shingles the
  first floor(n / 4) + l of either hold l common ones. Each set emits floor(n / 4) + floor(n / 10) + 1 shingles by hash and
  takes back the most frequent ceil(3 n / 4) // 10 of them: of the common ones the rarest stays in both. A region is the
  sets that keep a shingle. Most sets have so many shingles of their own that they keep nothing else and are done.
* Pivots. Each region is seen from its most central set, the one whose shingles most other sets have; sets that link
  with it are one component. Regions of over FEW sets with several components left get further pivots, from outside of
  their largest component, as long as these link something.
* Recursion. Regions in which two components meet are split anew, now by all shingles of their sets, those first that the
  fewest components have: a shingle of one component can't be shared with another, so that of a large group only what
  its sets don't have in common is looked at. Two sets of different components are compared if a common shingle stands
  early enough in both for their sizes, if they pass the triangle window (seen from a pivot of both, their distances
  differ by R at most), and if sketches of both are no farther apart than sets that link.

So sets of one component are never paired. Only a cloud of sets that share nearly all of their shingles, keep a common
distance just beyond R and have no centre is compared pair by pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks_of, forget, grams, sequence_hash, stored, utf8, within, words

N = 5  #: words of a shingle
BITS = 16  #: longs of a set's sketch
FEW = 64  #: sets of a region that needs no second pivot
SMALL = 200_000  #: rows of ids that are broadcast, if counted
PARTS = 2  #: parts of the shingles, a power of two: only one's shuffle files are on disk at a time


def _shingles(w: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text's word hashes, as signed numbers."""
    if not len(w):
        return np.zeros(0, np.int64)
    return np.unique(grams(w, min(N, len(w))).view(np.int64))


def _sketch(s: np.ndarray) -> np.ndarray:
    """64 * BITS parities of shingles by hash: two sketches differ in no more bits than their sets in shingles."""
    odd = np.bincount((s.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * BITS), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _emitted(n: int) -> int:
    return n // 4 + n // 10 + 1


def _dropped(n: Column) -> Column:
    """How many of the emitted shingles a set leaves out: fewer than any two sets that link have in common of them."""
    return F.floor(F.ceil(n * 3 / 4) / 10).cast("int")


def _sets(whole: bool):
    """For mapInArrow: (d, t, text) rows become (d, t, c, n, s, b): content hash, set size, the set or what it emits, a sketch.

    Unless the set is wanted whole, b is null, and s too where the task had the same content shortly before.
    """

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in blocks_of(batch, "text"):
                w, _, _, rows = words(*utf8(part.column("text")))
                c, n, sets = [], [], []
                for k in range(part.num_rows):
                    own = w[rows[k] : rows[k + 1]]
                    key = sequence_hash(own)
                    s = _shingles(own)
                    c.append(key)
                    n.append(len(s))
                    again = not whole and key in seen
                    sets.append(None if again else s if whole else s[: _emitted(len(s))])
                    if len(seen) >= 1 << 17:
                        seen.clear()
                    seen.add(key)
                at = np.concatenate(([0], np.cumsum([0 if s is None else len(s) for s in sets])))
                flat = np.concatenate([s for s in sets if s is not None] or [np.zeros(0, np.int64)])
                lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(flat, pa.int64()), mask=pa.array([s is None for s in sets])).cast(pa.list_(pa.int64()))
                bits = pa.array([_sketch(s) if whole else None for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("t"), pa.array(c, pa.int64()), pa.array(n, pa.int64()), lists, bits], names=["d", "t", "c", "n", "s", "b"])

    return work


SET = "d long, t long, c long, n long, s array<long>, b array<long>"


class JaccardJoin:
    """Components of docs(doc_id, text) under links of Jaccard similarity 0.75 or more on sets of N-word shingles."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), "text")
        read = stored(self.keyed.mapInArrow(_sets(False), SET))
        #: (d, t, c, n): one for each row of docs; t is a hash of the text.
        self.rows = stored(read.select("d", "t", "c", "n"))
        first = read.where("n > 0").groupBy(F.col("c").alias("x")).agg(F.first("n").alias("n"), F.min("d").alias("rep"), F.first("s", True).alias("s"))
        #: (x, n, rep, s): a class for each distinct sequence of words, the doc_id of one document with it, what it emits.
        self.classes = stored(first)
        forget(read)

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(x, n, s, b): the whole sets of the classes wanted(x), and their sketches."""
        wanted = within(wanted, SMALL)
        docs = self.classes.join(wanted, "x", "left_semi").select(F.col("rep").alias("d")).distinct()
        docs = within(docs, SMALL)
        text = self.keyed.join(docs, self.keyed.d.eqNullSafe(docs.d), "left_semi")
        # A doc_id may have several texts, and a null one too: other classes that come along go.
        sets = text.mapInArrow(_sets(True), SET).select(F.col("c").alias("x"), "n", "s", "b").where("n > 0")
        return stored(sets.join(wanted, "x", "left_semi").dropDuplicates(["x"]))

    def regions(self) -> DataFrame:
        """(g, x, n, score) of the shingles that each class keeps, regions of one class left out.

        score is the mean number of classes that have a shingle which the class emits. Emitted shingles are counted and
        met a part of them at a time, and forgotten then: they are the most rows of all.
        """
        shared = []
        for part in range(PARTS):
            emitted = self.classes.select("x", F.explode("s").alias("g")).where(F.col("g").bitwiseAND(PARTS - 1) == part)
            counted = stored(emitted.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"))
            # counted grows with the input, so it is never broadcast
            shared.append(stored(emitted.join(counted.hint("merge"), "g").select("x", "m", "g")))
            forget(counted)
        whole, self.classes = self.classes, stored(self.classes.select("x", "n", "rep"))
        forget(whole)
        met = reduce(DataFrame.union, shared).groupBy("x").agg(F.sort_array(F.collect_list(F.struct("m", "g")), False).alias("met"))
        met = met.join(self.classes.select("x", "n"), "x")
        kept = met.where(F.size("met") > _dropped(F.col("n"))).withColumn("score", F.aggregate("met", F.lit(0).cast("long"), lambda a, t: a + t["m"]) / (F.floor(F.col("n") / 4) + F.floor(F.col("n") / 10) + 1))
        kept = stored(kept.select("x", "n", "score", F.explode(F.slice("met", _dropped(F.col("n")) + 1, F.size("met"))).alias("k")).select(F.col("k.g").alias("g"), "x", "n", "score"))
        forget(*shared)
        return kept

    def compared(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """pairs(x, p) of classes with their distance u and whether they link, stored."""
        both = pairs.join(sets, "x").join(sets.select(F.col("x").alias("p"), F.col("n").alias("m"), F.col("s").alias("t")), "p")
        both = both.select("x", "p", "n", "m", F.size(F.array_intersect("s", "t")).cast("long").alias("shared"))
        union = F.col("n") + F.col("m") - F.col("shared")
        return stored(both.select("x", "p", (1 - F.col("shared") / union).alias("u"), (4 * F.col("shared") >= 3 * union).alias("linked")))

    def labels(self, most_rounds: int = 16) -> DataFrame:
        """(x, root) of every class that links with another: the least class of its component."""
        regions = self.regions()
        pivot = regions.groupBy("g").agg(F.max(F.struct("score", "x", "n")).alias("p"), F.count("*").alias("size")).where("size > 1")
        pivots = stored(pivot.select("g", F.col("p.x").alias("p"), F.col("p.n").alias("m"), "size"))
        members = stored(regions.join(pivots.select("g", "size"), "g").select("g", "x", "n", "score", "size"))
        forget(regions)
        sets = self.sets_of(members.select("x").distinct())
        sizes_fit = F.expr("4 * least(n, m) >= 3 * greatest(n, m)")
        near = self.compared(members.join(pivots.select("g", "p", "m"), "g").where("x != p").where(sizes_fit).select("x", "p").distinct(), sets)
        label = self.joined(self.spark.createDataFrame([], "x long, root long"), near)
        used, seen, tables = pivots.select("g", F.col("p").alias("x")), near, [pivots]
        for _ in range(most_rounds):
            mixed = self.mixed(members.where(F.col("size") > FEW), label)
            outside = mixed.where("root != big").join(used, ["g", "x"], "left_anti")
            pivots = stored(outside.groupBy("g").agg(F.max(F.struct("score", "x", "n", "root")).alias("p")).select("g", F.col("p.x").alias("p"), F.col("p.n").alias("m"), F.col("p.root").alias("r")))
            pairs = mixed.join(pivots, "g").where("root != r").where(sizes_fit).select("x", "p").distinct()
            more = self.compared(pairs.join(seen.select("x", "p"), ["x", "p"], "left_anti"), sets)
            tables += [more, pivots]
            seen, used = seen.union(more), used.union(pivots.select("g", F.col("p").alias("x")))
            n, links = more.agg(F.count("*"), F.count_if("linked")).first()
            if not links:
                break
            label = self.joined(label, more)
            if links < n / 10:  # the recursion finds what is left with less work
                break
        # The distance to the nearest pivot, for the window.
        home = seen.groupBy("x").agg(F.min(F.struct("u", "p")).alias("home"))
        pivots_home = seen.select(F.col("p").alias("x"), F.struct(F.lit(0.0).alias("u"), "p").alias("home")).distinct()
        home = stored(home.join(pivots_home.select("x"), "x", "left_anti").union(pivots_home))
        left = stored(self.mixed(members, label).select("x").distinct())
        forget(members, *tables)
        found = self.compared(self.split(left, sets, label, home), sets)
        out = self.joined(label, found)
        forget(found, near, home, left, sets)
        return out

    def mixed(self, members: DataFrame, label: DataFrame) -> DataFrame:
        """members(g, x, ...) of the regions with several components, with their root and big, the root of most."""
        rooted = members.join(label, "x", "left").withColumn("root", F.coalesce("root", "x"))
        count = rooted.groupBy("g", "root").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "root")).alias("big"), F.count("*").alias("roots"))
        return rooted.join(count.where("roots > 1").select("g", F.col("big.root").alias("big")), "g")

    def split(self, left: DataFrame, sets: DataFrame, label: DataFrame, home: DataFrame) -> DataFrame:
        """(x, p): the pairs of classes left(x) in different components that may link.

        Shingles are in the order of the number of components that have them. With sizes n and m, two sets that link have
        at least a = ceil(3 (n + m) / 7) shingles in common, so the first common one is among the first n - a + 1 and
        m - a + 1, and they differ in n + m - 2 a at most, as do their sketches.
        """
        rooted = sets.join(left, "x", "left_semi").join(label, "x", "left").join(home, "x", "left").select("x", "n", "s", "b", F.coalesce("root", "x").alias("root"), F.col("home.u").alias("u"), F.col("home.p").alias("h"))
        rows = rooted.select("x", "root", F.explode("s").alias("g"))
        shared = stored(rows.select("g", "root").distinct().groupBy("g").agg(F.count("*").alias("m")).where("m > 1"))
        met = rows.join(shared, "g").groupBy("x").agg(F.sort_array(F.collect_list(F.struct("m", "g"))).alias("met"))
        at = F.posexplode("met").alias("k", "t")
        placed = rooted.drop("s").join(met, "x").select("x", "n", "b", "root", "u", "h", (F.col("n") - F.size("met")).alias("own"), at)
        placed = stored(placed.withColumn("at", F.col("own") + F.col("k")).where("at <= floor(n / 4)").select(F.col("t.g").alias("g"), "x", "n", "b", "root", "u", "h", "at"))
        count = placed.groupBy("g", "root").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "root")).alias("big"), F.count("*").alias("roots"))
        mixed = stored(placed.join(count.where("roots > 1").select("g", F.col("big.root").alias("big")), "g"))
        a = mixed.where("root != big").drop("big")
        b = mixed.select("g", *[F.col(c).alias(f"{c}2") for c in ("x", "n", "b", "root", "u", "h", "at")])
        common = F.expr("(3 * (n + n2) + 6) div 7")
        window = F.col("h").isNull() | F.col("h2").isNull() | (F.col("h") != F.col("h2")) | (F.abs(F.col("u") - F.col("u2")) <= 0.25 + 1e-9)
        apart = sum(F.bit_count(F.col("b")[k].bitwiseXOR(F.col("b2")[k])) for k in range(BITS))
        fits = (F.col("root") != F.col("root2")) & (F.col("at") + common <= F.col("n")) & (F.col("at2") + common <= F.col("n2")) & window
        pairs = a.join(b, (a.g == b.g) & fits & (apart <= F.col("n") + F.col("n2") - 2 * common))
        pairs = stored(pairs.select(F.least("x", "x2").alias("x"), F.greatest("x", "x2").alias("p")).distinct())
        forget(shared, placed, mixed)
        return pairs

    def joined(self, label: DataFrame, near: DataFrame) -> DataFrame:
        """label(x, root) after the links of near(x, p, linked); sets without a link have no row. Stored; label is deleted."""
        root = label.select(F.col("x").alias("y"), "root")
        links = near.where("linked").select("x", "p")
        ends = links.join(root.select(F.col("y").alias("x"), F.col("root").alias("a")), "x", "left").join(root.select(F.col("y").alias("p"), F.col("root").alias("b")), "p", "left")
        ends = ends.select(F.coalesce("a", "x").alias("x"), F.coalesce("b", "p").alias("p")).where("x != p").distinct()
        over = _connected(ends)  # of roots
        to = over.select(F.col("x").alias("root"), F.col("root").alias("to"))
        moved = label.join(to, "root", "left").select("x", F.coalesce("to", "root").alias("root"))
        new = over.join(label.select("x"), "x", "left_anti")
        out = stored(moved.union(new))
        forget(label, over)
        return out

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row of docs."""
        label = self.labels()
        low = self.classes.select("x", "rep").join(label, "x", "left").select("x", F.coalesce("root", "x").alias("root"), "rep")
        least = low.groupBy("root").agg(F.min("rep").alias("component_id"))
        of_class = stored(low.join(least, "root").select(F.col("x").alias("c"), "component_id"))
        forget(label, self.classes)
        out = self.rows.join(of_class, "c", "left")
        return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("d")).otherwise(F.col("component_id")).alias("component_id"))

    def surplus(self) -> DataFrame:
        """(d, t) of the documents that go if one of each component stays: the one of the least doc_id, then of t."""
        label = self.labels()
        rows = self.rows.where("n > 0").join(label.withColumnRenamed("x", "c"), "c", "left").select(F.coalesce("root", "c").alias("root"), "d", "t")
        place = F.struct(F.col("d").isNull().alias("last"), "d", "t")
        first = rows.groupBy("root").agg(F.min(place).alias("first"), F.max(place).alias("other")).where("first != other").select("root", "first")
        out = stored(rows.join(first, "root").where(place != F.col("first")).select("d", "t").distinct())
        forget(label, self.classes)
        return out


def _connected(links: DataFrame) -> DataFrame:
    """(x, root) of the nodes of links(x, p): the least node that each reaches. Stored.

    Labels spread along links and are then followed to the label's own label, so that a chain shrinks by a power of two
    a round; rounds end when no label changes.
    """
    both = stored(links.select("x", F.col("p").alias("y")).union(links.select(F.col("p"), F.col("x"))).distinct())
    label = stored(both.groupBy("x").agg(F.least("x", F.min("y")).alias("root"), F.lit(True).alias("moved")))
    while not label.where("moved").isEmpty():
        around = both.join(label.select(F.col("x").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        over = label.select(F.col("x").alias("root"), F.col("root").alias("next"))
        least = F.least("root", "near", "next")
        step = stored(label.join(around, "x").join(over, "root").select("x", least.alias("root"), (least != F.col("root")).alias("moved")))
        forget(label)
        label = step
    forget(both)
    out = label.select("x", "root")
    out._stored_at = label._stored_at
    return out


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text, ...); see JaccardJoin.

    A set is the distinct N-word shingles of the words `[^\\x20\\x09-\\x0D]+` of the whole text, A-Z lower-cased; a text
    with fewer words has one shingle, the whole sequence; without words it has none and links with nothing (its
    component_id is its own doc_id, null or not). component_id is the least doc_id that links reach; null doc_ids take
    part but name no component unless it has no other. Shingles and sequences are told apart by 64-bit hashes. Equal
    texts are one class, so groups of exact copies are never paired. Every row has a row in the result, repeated ones
    too; an empty table gives an empty one. Extra columns are ignored.
    """
    return JaccardJoin(docs).components()


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one document of each component: the one of the least doc_id (null last).

    Texts without words are in no component, so all of them stay. Documents are told apart by doc_id and text: where a
    doc_id has several texts, each is judged by itself, and of equal rows one stays. An empty table gives an empty one.
    Other columns are kept.
    """
    join = JaccardJoin(docs)
    keys = [F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t")]
    same = lambda a, b: a["_d"].eqNullSafe(b["_d"]) & (a["_t"] == b["_t"])
    rows = docs.select("*", *keys)
    gone = join.surplus().select(F.col("d").alias("_d"), F.col("t").alias("_t"))
    kept = rows.join(gone, same(rows, gone), "left_anti")
    again = join.rows.where("n > 0").groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    if not again.isEmpty():
        again = stored(again)
        one = kept.join(again, same(kept, again), "left_semi").dropDuplicates(["_d", "_t"])
        kept = kept.join(again, same(kept, again), "left_anti").union(one)
    return kept.select(*docs.columns)
