import random

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import codec, pieces
from lexmill.operators import index as ix

LISTS = {"a": sorted(random.Random(5).sample(range(500), 120)), "b": [7], "c": list(range(0, 400, 3)), "d": [2**40, 2**40 + 1]}


def postings(spark, rows, parts):
    return spark.createDataFrame(rows, "term string, doc_id long").repartition(parts)


def test_gaps_of_rows_in_any_order(spark, monkeypatch):
    rows = [(t, d) for t, x in LISTS.items() for d in x]
    random.Random(3).shuffle(rows)
    want = {(t, k, y - x) for t, ids in LISTS.items() for k, (x, y) in enumerate(zip([0, *ids], ids))}
    for block, parts in ((16, 5), (1 << 20, 3)):
        coded = codec.gaps(postings(spark, rows, parts), block)
        assert {tuple(r) for r in coded.collect()} == want and coded.count() == len(want)
        back = codec.ungapped(coded.repartition(4, F.rand(1)), block)
        assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_gaps_of_nulls_and_repeats(spark):
    index = postings(spark, [("a", 3), ("a", 3), ("a", None), ("b", None), ("a", 1), (None, 4)], 2)
    got = codec.gaps(index, 2).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [("a", 0, 1), ("a", 1, 2), ("a", 2, 0), ("a", 3, None), ("b", 0, None), (None, 0, 4)]))
    back = sorted(map(repr, map(tuple, codec.ungapped(codec.gaps(index, 2), 2).collect())))
    assert back == sorted(map(repr, map(tuple, index.collect())))
    lists = {r.term: (r.df, r.doc_ids) for r in ix.posting_lists(index).collect()}
    assert lists == {"a": (4, [1, 3]), "b": (1, []), None: (1, [4])}


def test_lists_are_shuffled_as_arrays(spark):
    rows = spark.range(20_000).select(F.lit("x").alias("term"), F.col("id").alias("doc_id"))
    assert pieces.cut(rows.coalesce(1), 1 << 20).count() <= 4
    for found in (codec.gaps(rows), codec.ungapped(codec.gaps(rows)), ix.posting_lists(rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan


def test_groups_over_batches(monkeypatch):
    monkeypatch.setattr(pieces, "AT_ONCE", 3)
    rows = [("a", 0, [1, 5]), ("a", 0, [2]), ("a", 0, [3, 4]), ("a", 1, [9]), ("b", 0, [0]), ("b", 0, [7, 8, 9, 10]), ("c", 2, [1])]
    for size in (1, 2, 7):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("term", "block", "ids"), r)) for r in rows[k : k + size]], pa.schema({"term": pa.string(), "block": pa.int64(), "ids": pa.list_(pa.int64())})) for k in range(0, 7, size)]
        got = []
        for names, term, block, at, ids in pieces.groups(iter(batches)):
            ends = [*at[1:], len(ids)]
            got += [(names[int(t)].as_py(), int(b), ids[i:j].tolist()) for t, b, i, j in zip(term, block, at, ends)]
        assert got == [("a", 0, [1, 2, 3, 4, 5]), ("a", 1, [9]), ("b", 0, [0, 7, 8, 9, 10]), ("c", 2, [1])]
