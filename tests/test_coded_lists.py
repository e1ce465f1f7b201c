from pyspark.sql import functions as F

from lexmill.functions import codec


def test_long_lists_are_coded_in_linear_time(spark):
    ids = spark.range(1).select(F.sequence(F.lit(1).cast("long"), F.lit(300_000).cast("long"), F.lit(1).cast("long")).alias("ids"))
    back = ids.select(codec.ungap_list(codec.unvbyte(codec.vbyte(codec.gap_list(F.col("ids"))))).alias("back"), "ids")
    assert back.where("back = ids").count() == 1


def test_coding_of_nulls_and_cut_bytes(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [5, None, 2**62]), (3, [128, 127, 0])], "k int, x array<long>").coalesce(1)
    got = [r.p if r.p is None else bytes(r.p) for r in df.select("k", codec.vbyte(F.col("x")).alias("p")).orderBy("k").collect()]
    assert got[:2] == [None, b""] and got[2] == b"\x85" + b"\0" * 8 + b"\xc0" and got[3] == bytes.fromhex("0081FF80")
    cut = spark.createDataFrame([(0, None), (1, bytes.fromhex("8503")), (2, b""), (3, bytes.fromhex("03")), (4, bytes.fromhex("0081"))], "k int, p binary").coalesce(1)
    assert [r.x for r in cut.select("k", codec.unvbyte(F.col("p")).alias("x")).orderBy("k").collect()] == [None, [5], [], [], [128]]
