import struct

import pytest
from pyspark.sql import functions as F

from lexmill.functions.codec import encode_list
from lexmill.operators import index as ix
from lexmill.sources import binary_index

LISTS = {f"t{k:03d}": list(range(k, 4000, 7 * k + 1)) for k in range(60)} | {"é": [2**33], "none": []}


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(list(LISTS.items()), "term string, doc_ids array<long>").repartition(5)


def test_one_file_is_as_it_was(spark, lists, tmp_path):
    size = binary_index.export_index(lists, str(tmp_path / "x.bin"))
    data = (tmp_path / "x.bin").read_bytes()
    body = b"".join(struct.pack("<HI", len(t.encode()), len(x)) + t.encode() + encode_list(x) for t, x in sorted(LISTS.items()))
    assert data[:-4] == b"INVI_100" + struct.pack("<I", len(LISTS)) + body and len(data) == size
    assert len(binary_index.parse_index(data, verify=True)) == len(LISTS)
    with pytest.raises(binary_index.BadIndex):
        binary_index.parse_index(data[:-5])
    with pytest.raises(binary_index.BadIndex):
        binary_index.parse_index(data[:-1] + bytes([data[-1] ^ 1]), verify=True)


def test_files_of_bounded_size(spark, lists, tmp_path, monkeypatch):
    monkeypatch.setattr(binary_index, "ENTRIES", 400)
    ended = []
    size = binary_index.export_files(lists, str(tmp_path), 2000, ended.append)
    files = sorted(tmp_path.iterdir())
    assert [str(x) for x in files] == ended and len(files) > 3 and sum(x.stat().st_size for x in files) == size
    assert sorted(x.stat().st_size for x in files)[-2] <= 2004  # t000 alone is longer
    terms = [t for x in files for t, _, _ in binary_index.parse_index(x.read_bytes(), verify=True)]
    assert terms == sorted(LISTS)
    back = binary_index.import_index(spark, str(tmp_path), verify=True)
    assert {r.term: (r.df, r.doc_ids) for r in back.collect()} == {t: (len(x), x) for t, x in LISTS.items()}


def test_no_terms_and_wrong_lists(spark, lists, tmp_path):
    assert binary_index.export_files(lists.limit(0), str(tmp_path)) == 16
    assert binary_index.import_index(spark, str(tmp_path), verify=True).count() == 0
    for wrong in (lists.limit(1).select(F.repeat(F.lit("x"), 65536).alias("term"), "doc_ids"), spark.createDataFrame([("a", [5, 3])], lists.schema)):
        with pytest.raises(ValueError):
            binary_index.export_index(wrong, str(tmp_path / "y"))


def test_decoding_is_in_bounded_batches(spark, tmp_path, monkeypatch):
    rows = spark.range(50_000).select(F.concat(F.lit("w"), F.col("id") % 500).alias("term"), F.col("id").alias("doc_id"))
    binary_index.export_index(ix.posting_lists(rows), str(tmp_path / "x.bin"))
    monkeypatch.setattr(binary_index, "AT_ONCE", 1000)
    back = binary_index.import_index(spark, str(tmp_path / "x.bin"))
    assert back.select("term", F.explode("doc_ids").alias("doc_id")).exceptAll(rows).isEmpty() and back.where("size(doc_ids) = df").count() == 500
