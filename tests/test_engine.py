import io
import os

import pytest
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.functions import codec
from lexmill.operators import index as ix
from lexmill.operators import stats
from lexmill.plans import boolean as b
from lexmill.sources import binary_index, corpus, results

INDEX = {"alpha": [1, 3, 6], "beta": [3, 9]}
CASES = [
    ("alpha", [1, 3, 6]), ("missing", []), ("alpha beta \\and", [3]), ("alpha beta \\or", [1, 3, 6, 9]), ("alpha \\not", [9]),
    ("missing \\not", [1, 3, 6, 9]), ("alpha beta \\not \\and", [1, 6]), ("alpha beta \\and \\not", [1, 6, 9]), ("alpha \\not \\not", [1, 3, 6]),
    ("(and) alpha", [1, 3, 6]), ("ALPHA beta AND", [3]), ("alpha \\not beta \\not \\or", [1, 6, 9]),
]
WRONG = ["", "the", "\\not", "alpha \\and", "alpha beta", "alpha AND beta", "alpha beta \\not", "the alpha \\and", "sky-lake"]


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([(t, d) for t, ids in INDEX.items() for d in ids], "term string, doc_id long")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_queries_by_every_plan(index):
    engine = b.BooleanEngine(index)
    for query, want in CASES:
        tree = engine.parse(query)
        assert ids(engine.query(query)) == want, query
        assert ids(b.relational(index, tree)) == want, query


def test_batch_isolates_errors(index):
    found, errors = b.BooleanEngine(index).run_queries([q for q, _ in CASES] + WRONG)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in enumerate(CASES) if want}
    assert sorted(errors) == list(range(len(CASES), len(CASES) + len(WRONG)))


@pytest.mark.parametrize("query", WRONG)
def test_wrong_queries(query):
    with pytest.raises(b.QuerySyntaxError):
        b.parse_postfix(b.query_tokens(query))


def test_arity():
    for operator, n in (("\\and", 1), ("\\or", 3), ("\\not", 2), ("\\xor", 2)):
        with pytest.raises(ValueError):
            b.checked(operator, n)


def test_infix(index):
    engine = b.BooleanEngine(index)
    assert ids(engine.query("alpha OR beta AND NOT beta", True)) == [1, 3, 6]
    assert ids(engine.query("(alpha OR beta) NOT beta", True)) == [1, 6]
    for wrong in ("alpha beta", "(alpha", "alpha AND", "OR alpha", ")"):
        with pytest.raises(b.QuerySyntaxError):
            engine.parse(wrong, True)


def test_codec(spark):
    assert codec.encode_list([300]).hex() == "2c82"
    assert codec.encode_list([]) == b"" and codec.encode_list([0]) == b"\x80"
    assert codec.decode_list(bytes.fromhex("8144B2018985")) == [1, 6469, 7622, 7627]
    with pytest.raises(ValueError):
        codec.encode_list([5, 3])
    lists = [[5, 8, 14, 100], [0], [], [2**31, 2**40]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<long>").withColumn("gaps", codec.gap_list(F.col("ids")))
    got = df.select("k", "gaps", codec.vbyte(F.col("gaps")).alias("p"), codec.unvbyte(codec.vbyte(F.col("gaps"))).alias("back")).orderBy("k").collect()
    assert [bytes(r.p) for r in got] == [codec.encode_list(x) for x in lists]
    assert [r.back for r in got] == [r.gaps for r in got] and got[0].gaps == [5, 3, 6, 86]


def test_index_of_small_corpus(spark, tmp_path):
    for name, body in {"a": "information retrieval", "b": "boolean retrieval model", "c": "inverted index", "d": ""}.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "sub").mkdir()
    docs = corpus.read_corpus(spark, str(tmp_path))
    lists = {r.term: r.doc_ids for r in ix.posting_lists(ix.postings(docs)).collect()}
    assert lists == {"retriev": [0, 1], "inform": [0], "boolean": [1], "model": [1], "invert": [2], "index": [2]}
    assert docs.count() == 4
    other = corpus.read_corpus(spark, str(tmp_path), offset=500, start=0, stop=2)
    assert ids(other) == [500, 501]


def test_order_of_files_and_bad_utf8(spark, tmp_path):
    for name in ("10", "2", "1", "20", ".hidden"):
        (tmp_path / name).write_text("x")
    assert [os.path.basename(x) for x in corpus.list_corpus(str(tmp_path))] == [".hidden", "1", "10", "2", "20"]
    (tmp_path / "bad").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="decode"):
        corpus.read_corpus(spark, str(tmp_path)).collect()


def test_assigned_ids(spark, tmp_path):
    files = spark.createDataFrame([(x,) for x in ("10", "2", "1", "20")], "path string")
    assert {r.path: r.doc_id for r in ix.assign_doc_ids(files, str(tmp_path / "a"), 7).collect()} == {"1": 7, "10": 8, "2": 9, "20": 10}
    assert ix.assign_doc_ids(files.limit(0), str(tmp_path / "b")).count() == 0


def test_assigned_ids_of_a_wide_table(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        files = spark.range(20_000).select(F.concat(F.lit("f"), F.lpad("id", 6, "0")).alias("path"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 150).alias("text"))
        numbered = ix.assign_doc_ids(files, str(tmp_path / "a"), 5)
        assert numbered.columns == ["path", "text", "doc_id"]
        got = numbered.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("doc_id") != F.substring("path", 2, 6).cast("long") + 5).alias("wrong")).first()
        assert tuple(got) == (20_000, 20_000, 0) and numbered.where("length(text) != 19200").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_deep_and_wide_queries(index):
    engine = b.BooleanEngine(index)
    assert ids(engine.query("alpha" + " \\not" * 4000)) == [1, 3, 6]
    many = " ".join(f"t{k} \\or" for k in range(200))
    assert ids(engine.query(f"alpha {many}")) == [1, 3, 6] and ids(engine.query(f"alpha {many} beta \\and")) == [3]
    right = " ".join(f"t{k}" for k in range(200)) + " alpha" + " \\or" * 200  # a chain that nests to the right
    assert ids(engine.query(right)) == [1, 3, 6] and max(map(len, [b.steps_of(engine.parse(right))])) == 401
    found, _ = engine.run_queries([f"alpha {many}", right, f"alpha {many} \\not", "beta"])
    got = sorted((r.query_id, r.doc_id) for r in found.collect())
    assert got == [(0, 1), (0, 3), (0, 6), (1, 1), (1, 3), (1, 6), (2, 9), (3, 3), (3, 9)]
    assert b.parse_infix("(" * 3000 + "alpha" + ")" * 3000) == ("alpha",)


def test_gaps_in_blocks(spark):
    lists = {"a": [0, 3, 4, 9, 17, 40], "b": [5], "c": [8, 16, 24]}
    index = spark.createDataFrame([(t, d) for t, x in lists.items() for d in x], "term string, doc_id long")
    coded = codec.gaps(index, 8)
    got = {}
    for r in sorted(coded.collect()):
        got.setdefault(r.term, []).append((r.pos, r.gap))
    assert got == {t: list(enumerate(y - x for x, y in zip([0, *ids], ids))) for t, ids in lists.items()}
    assert sorted(map(tuple, codec.ungapped(coded, 2).collect())) == sorted(map(tuple, index.collect()))
    blocks = sorted((r.term, r.block, r.df, r.doc_ids) for r in ix.posting_blocks(index, 8).collect())
    assert blocks[0] == ("a", 0, 3, [0, 3, 4]) and sum(x[2] for x in blocks) == 10


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta"), (3, ""), (4, None)], "doc_id long, text string")
    stored = ix.store_index(docs, str(tmp_path / "index"))
    assert sorted(map(tuple, stored.tf.collect())) == [("alpha", 1, 1), ("beta", 1, 2), ("beta", 2, 1)]
    assert sorted(map(tuple, stored.documents.collect())) == [(1, 3), (2, 1)]
    assert ids(b.BooleanEngine.on(stored).query("alpha \\not")) == [2]
    plan = b.BooleanEngine.on(stored).query("alpha")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [alpha])]" in plan or "EqualTo(term,alpha)" in plan


def test_query_files(spark, tmp_path):
    path = tmp_path / "queries.txt"
    path.write_text("# comment\n\n  alpha \n beta alpha \\and\n")
    assert corpus.query_list(str(path)) == ["alpha", "beta alpha \\and"]
    assert sorted(r.query for r in corpus.load_queries(spark, str(path)).collect()) == ["alpha", "beta alpha \\and"]
    path.write_text("# nothing\n")
    with pytest.raises(ValueError):
        corpus.query_list(str(path))


def test_remote_corpus(spark, tmp_path):
    (tmp_path / "a").write_text("alpha")
    (tmp_path / "b").write_text("")
    got = {os.path.basename(r.path): r.text for r in corpus.read_remote_corpus(spark, str(tmp_path)).collect()}
    assert got["a"] == "alpha"


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("short", 1.5)], "category string, mean_ms double")
    results.write_results(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("category", "mean_ms").collect()] == [("short", 1.5)]
    folder = tmp_path / "results"
    folder.mkdir()
    for name, n in (("init_20260101_000000", 1), ("init_20260102_000000", 2), ("query_short_20260101_000000", 3)):
        (folder / f"{name}.json").write_text('{"n": %d}' % n)
    assert {r.kind: r.n for r in results.read_results(spark, str(folder)).collect()} == {"init": 2, "query_short": 3}


def test_binary_index(spark, index, tmp_path):
    path = str(tmp_path / "index.bin")
    binary_index.export_index(ix.posting_lists(index), path)
    assert {r.term: (r.df, r.doc_ids) for r in binary_index.import_index(spark, path, verify=True).collect()} == {t: (len(x), x) for t, x in INDEX.items()}
    golden = bytes.fromhex("494E56495F31303001000000050003000000" + "4A4B4C4D4E" + "818283")
    assert [(t, n, codec.decode_list(p)) for t, n, p in binary_index.parse_index(golden)] == [("JKLMN", 3, [1, 3, 6])]
    assert binary_index.parse_index(b"x" * 18) == []
    with pytest.raises(binary_index.BadIndex):
        binary_index.parse_index(b"WRONG_MAGIC_AND_MORE")


def test_written_index_and_cli(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"{k}.txt").write_text("common term" + (" rare" if k == 3 else ""))
    cli.build(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    engine = b.BooleanEngine.open(spark, str(tmp_path / "out"))
    out = io.StringIO()
    cli.bench(engine, ["rare", "common rare \\not \\and", "common rare", "EXIT", "rare"], out)
    assert out.getvalue() == "READY\n3\n0 1 2 4 5\n\n"
    out = io.StringIO()
    cli.interactive(engine, ["", "rare", "quit"], out)
    assert out.getvalue() == "Results: [3]\n\n"
    with pytest.raises(SystemExit):
        cli.build(spark, str(tmp_path / "none"), str(tmp_path / "x"))


def test_statistics(spark):
    df = spark.createDataFrame([(f"t{k}", n) for k, n in enumerate([1, 1, 2, 5, 9, 9])], "term string, df long")
    row = stats.posting_length_stats(df).first()
    assert (row.min_df, row.median_df, row.max_df, row.mean_df) == (1, 5, 9, 4.5)
    assert [r.term for r in stats.mid_frequency_terms(df).collect()] == ["t4", "t5"]
    assert stats.rare_term_share(df).first().passed
    lists = spark.createDataFrame([("a", 2, [1, 2]), ("b", 2, [2, 1]), ("c", 1, [7, 7])], "term string, df long, doc_ids array<long>")
    row = stats.posting_invariants(lists, 5).first()
    assert (row.unsorted, row.repeated, row.negative, row.too_large, row.df_mismatch) == (1, 1, 0, 1, 1)


def test_shards(spark):
    got = sorted((r.doc_id, r.shard) for r in ix.with_shards(spark.range(11).withColumnRenamed("id", "doc_id"), 4).collect())
    assert [s for _, s in got] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3, 3]


def test_streamed_postings(spark, tmp_path):
    from lexmill.streaming.append import append_postings

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = append_postings(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("term", "doc_id").collect()
    assert sorted(map(tuple, got)) == [("alpha", 1), ("beta", 1), ("beta", 2)]


def test_routing_by_catalog(spark):
    rows = [(0, "alpha", 1), (0, "beta", 1), (1, "beta", 5), (2, "alpha", 9), (2, "gamma", 9)]
    sharded = spark.createDataFrame(rows, "shard int, term string, doc_id long")
    plain = b.BooleanEngine(sharded.select("term", "doc_id"))
    for query in ("alpha", "alpha beta \\and", "alpha gamma \\or", "alpha beta \\not \\and", "beta \\not", "alpha \\not beta \\and", "alpha beta \\not \\or"):
        program = plain.parse(query)
        assert ids(b.routed(sharded, ix.shard_catalog(sharded), program)) == ids(plain.query(query)), query


def test_verbose_and_warm_up(index):
    engine, out = b.BooleanEngine(index), io.StringIO()
    lines = list(cli.warmed(engine, iter(["alpha", "alpha beta", "EXIT"]), 2))
    assert lines == ["alpha", "alpha beta", "EXIT"]
    answers = io.StringIO()
    cli.bench(cli.Timed(engine, out), lines, answers)
    assert answers.getvalue() == "READY\n1 3 6\n\n" and out.getvalue().startswith("3 documents in ")


def test_crc_of_terms(spark):
    import zlib

    row = spark.createDataFrame([("information",)], "term string").select(F.crc32(F.col("term").cast("binary")).alias("crc")).first()
    assert row.crc == zlib.crc32(b"information")
