import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lexmill.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    r = np.random.default_rng(8)
    word = lambda n: [f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{chr(97 + x // 676)}" for x in r.integers(0, 9000, n)]
    text = lambda n: " ".join(word(n))
    leak, twin = text(40), text(120)
    lines = "\n".join(text(9) for _ in range(6))
    rows = [(k, text(80), "aa", f"s{k % 3}") for k in range(40)]
    rows += [(50, None, None, "s0"), (51, "", None, "s1"), (52, "12 34", "aa", "s2"), (60, text(30) + " " + leak, "aa", "s0"), (61, twin, "aa", "s1"), (62, twin + " extra", "aa", "s1")]
    rows += [(70, lines, "aa", "s0"), (71, text(30) + "\n" + lines, "aa", "s2"), (72, lines, None, None)]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        ids.append({x.doc_id for x in at.collect()})
        if k < 4:
            assert at.columns == corpus_pipeline.COLUMNS
    everything = {d for d, *_ in rows}
    assert ids[0] == everything - {50, 51, 52}
    assert ids[1] == ids[0] - {72}  # all of its lines are document 70's
    assert ids[2] == ids[1] - {62} and ids[3] == ids[2] - {60} and ids[4] == ids[3]
    kept = {x.doc_id: x for x in spark.read.parquet(str(tmp_path / "1")).collect()}
    assert kept[71].text == rows[-2][1].split("\n")[0] and kept[71].n_chars == len(kept[71].text)
    whole = {x.doc_id: (x.size, x.taken) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {x.doc_id: (x.size, x.taken) for x in at.collect()}


def test_one_of_each_with_null_and_repeated_ids(spark, tmp_path):
    text = lambda c, n=40: " ".join(f"{c}{k}" for k in range(n))
    rows = [
        (1, text("a"), "aa", "s", 1), (2, text("a"), "aa", "s", 1),  # copies
        (3, text("b"), "aa", "s", 1), (3, text("b"), "aa", "s", 1),  # equal rows
        (4, text("c"), "aa", "s", 1), (4, text("d"), "aa", "s", 1),  # two texts of one id
        (5, text("d") + " more", "aa", "s", 1),  # a near copy of one of them
        (None, text("a"), "aa", "s", 1), (None, text("e"), "aa", "s", 1), (None, None, None, None, 0), (6, "", None, None, 0), (6, "", None, None, 0),
        (7, text("f", 30_000), "aa", "s", 1), (8, text("f", 30_000) + " end", "aa", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.by_similarity(spark, docs, "")
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=repr)
    want = [rows[k][:2] for k in (0, 2, 4, 5, 8, 9, 10, 11, 12)]
    assert out.columns == corpus_pipeline.COLUMNS and got == sorted(want, key=repr)
    spark.createDataFrame([(1, text("c")), (2, text("e"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(x.doc_id, x.text) for x in corpus_pipeline.by_benchmark(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=repr) == sorted(((d, t) for d, t, *_ in rows if t not in (text("c"), text("e"))), key=repr)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_registered_queries_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op1_toxicity", "op2_line_dedup", "op3_language_id", "op6_mixing", "op9_media"):
        assert queries.QUERIES[name](spark, DATA).count() == docs, name
    assert {x.split("_")[0] for x in queries.QUERIES} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}


def against_sql(spark, name, folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        files = f"{folder}/{file}" if os.path.isfile(f"{folder}/{file}") else f"{folder}/{file}/*.parquet"
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{files}')")
    df = queries.QUERIES[name](spark, folder)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(map(tuple, found.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    against_sql(spark, name, DATA)


def test_url_query_blocks_hosts_and_equals_sql(spark, tmp_path):
    hosts = ["a.good.com", "b.good.com", "spam.bad.com", "x.bad.com", "www.bad.net", "plain.org", "Localhost", ""]
    r = np.random.default_rng(1)
    pages = [(k, f"http://{hosts[k % 8]}/{('en', 'fr', 'de')[k % 3]}/{k}.html") for k in range(400)] + [(900, None), (901, "nothing"), (902, "http://x.bad.com/en/1?q=://y")]
    labels = [(k, None if k % 11 == 0 else 1, None if k % 7 == 0 else int(hosts[k % 8].endswith("bad.com") and r.random() < 0.9)) for k in range(300)] + [(5, 0, 0)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op5_url_filters"](spark, str(tmp_path)).where("rule is null").groupBy("host").agg({"verdict": "max", "page_id": "min"}).collect()
    assert {x.host for x in got if x["max(verdict)"] == "block"} == {"spam.bad.com", "x.bad.com"}
    against_sql(spark, "op5_url_filters", str(tmp_path))
