"""The registered queries: every operator over the driver's tables, with its SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import codec, text
from lexmill.functions.stem import with_stem
from lexmill.operators import index as ix
from lexmill.operators import stats
from lexmill.oracle import GAPS, INDEX, STEMS, STOPS, TF, has, indexed, stem_ctes
from lexmill.plans.boolean import BooleanEngine, batch, formatted, one_scan, relational, routed
from lexmill.sources.binary_index import export_files, import_index
from lexmill.sources.results import latest_results
from lexmill.sources.scratch import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(docs(spark, sf_dir))


_BUILT: dict[tuple[str, str], str] = {}


def held(spark: SparkSession, sf_dir: str) -> ix.StoredIndex:
    """The stored index of documents, built by the first query of an application that needs it; the others open it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = fresh_path(spark)
        ix.store_index(docs(spark, sf_dir), path)
        _BUILT[key] = path
    return ix.StoredIndex.open(spark, _BUILT[key])


def engine(spark: SparkSession, sf_dir: str) -> BooleanEngine:
    return BooleanEngine.on(held(spark, sf_dir))


# --- sources and sinks ---


@register("SELECT doc_id, 'page_' || doc_id || '.txt' AS path FROM documents")
def corpus_listing(spark, d):
    return docs(spark, d).select("doc_id", F.concat(F.lit("page_"), "doc_id", F.lit(".txt")).alias("path"))


@register("SELECT doc_id, text FROM documents")
def read_documents(spark, d):
    return docs(spark, d).select("doc_id", F.validate_utf8("text").alias("text"))


@register("SELECT 'page_' || doc_id || '.txt' AS path, 500 + row_number() OVER (ORDER BY 'page_' || doc_id || '.txt' COLLATE C) - 1 AS doc_id FROM documents".replace(" COLLATE C", ""))
def assign_doc_ids(spark, d):
    return ix.assign_doc_ids(corpus_listing(spark, d).select("path"), fresh_path(spark), 500).select("path", "doc_id")


@register(indexed("SELECT term, doc_id FROM postings"))
def build_index(spark, d):
    return index(spark, d)


@register(indexed("SELECT term, doc_id FROM postings"))
def index_sorted(spark, d):
    path = fresh_path(spark)
    ix.write_index(index(spark, d), path)
    return spark.read.parquet(path).select("term", "doc_id")


@register()
def term_crc32(spark, d):
    return ix.distinct_terms(docs(spark, d)).select("term", F.crc32(F.col("term").cast("binary")).alias("crc"))


@register(indexed("SELECT term, doc_id FROM postings"))
def binary_roundtrip(spark, d):
    """Export to index files of some MB by the driver, each moved to the shared folder once it is whole, and import."""
    folder = fresh_path(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path
    shared = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    shared.mkdirs(path(folder))
    with tempfile.TemporaryDirectory() as local:
        export_files(ix.posting_lists(held(spark, d).postings), local, ended=lambda x: shared.copyFromLocalFile(True, path(f"file://{x}"), path(folder)))
    return import_index(spark, folder, verify=True).select("term", F.explode("doc_ids").alias("doc_id"))


LINES = ["# a comment", "", "en er \\and", "  es  ", "   # another", "nd \\not"]


@register("SELECT trim(v) AS query FROM (VALUES " + ", ".join(f"('{x}')" for x in LINES) + ") AS t(v) WHERE trim(v) <> '' AND NOT starts_with(trim(v), '#')")
def load_query_file(spark, d):
    return spark.createDataFrame([(x,) for x in LINES], "value string").select(F.trim("value").alias("query")).where("query <> '' and not startswith(query, '#')")


@register("SELECT event_type AS kind, max(event_id) AS name, arg_max(value, event_id) AS value FROM events GROUP BY event_type", "latest_results")
def _latest(spark, d):
    return latest_results(events(spark, d).select(F.col("event_type").alias("kind"), F.col("event_id").alias("name"), "value"))


# --- text ---

_LIST = "regexp_extract_all(text, '[a-zA-Z0-9]+')"


def _tokens(spark, d, f) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(f(text.tokenize(F.col("text")))).alias("pos", "token")).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def _listed(tokens: str) -> str:
    return f"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS token FROM (SELECT doc_id, {tokens} AS l FROM documents)"


@register(_listed(_LIST))
def tokenize(spark, d):
    return _tokens(spark, d, lambda x: x)


@register(_listed(f"list_transform({_LIST}, lambda x: lower(x))"))
def casefold(spark, d):
    return _tokens(spark, d, text.casefold)


@register("SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS token FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')), lambda x: x <> '') AS l FROM documents)")
def strip_punct(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(text.strip_punctuation(F.split("text", " "))).alias("pos", "token")).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


@register(_listed(f"list_filter({_LIST}, lambda x: x NOT IN {STOPS})"))
def stopword_filter(spark, d):
    return _tokens(spark, d, text.drop_stop_words)


@register(f"WITH {STEMS} SELECT s AS surface, term AS stem FROM stems")
def stem_vocabulary(spark, d):
    return ix.vocabulary(docs(spark, d))


@register(f"WITH {STEMS} SELECT DISTINCT term AS stem FROM stems WHERE term NOT IN {STOPS}")
def post_stem_stop_filter(spark, d):
    return ix.vocabulary(docs(spark, d)).select("stem").distinct().where(~text.is_stop_word(F.col("stem")))


@register()
def stem_vocabulary_nltk(spark, d):
    return ix.vocabulary(docs(spark, d), nltk=True)


_SURFACE_LIST = f"list_filter(list_transform({_LIST}, lambda x: lower(x)), lambda x: x NOT IN {STOPS})"


@register(f"WITH {STEMS} SELECT doc_id, pos, term FROM ({_listed(_SURFACE_LIST)}) JOIN stems ON s = token WHERE term NOT IN {STOPS}")
def normalize(spark, d):
    return ix.normalized(docs(spark, d))


#: Postfix queries over the synthetic vocabulary, and the ones that are wrong.
BATCH = ["en er \\and", "es th \\or", "nd \\not", "zzzunknown", "zzzunknown \\not", "en er \\and th \\not \\and", "thtion attion \\or ertion \\and", "en er \\or es \\and \\not", "the en \\and", "en er", "\\not"]


_RAW = [(0, "en er \\and"), (1, "Sky-lake OR"), (2, "the running dogs NOT")]
_TOKENS_SQL = (
    "WITH raw(query_id, query) AS (VALUES " + ", ".join(f"({k}, '{q}')" for k, q in _RAW) + "), "
    "listed AS (SELECT query_id, string_split_regex(trim(query), '\\s+') AS l FROM raw), "
    "chunks AS (SELECT query_id, generate_subscripts(l, 1) AS c, unnest(l) AS chunk FROM listed), "
    "told AS (SELECT *, regexp_extract(lower(chunk), '^\\\\?(and|or|not)$', 1) AS op FROM chunks), "
    f"parts AS (SELECT query_id, c, CASE WHEN op <> '' THEN ['\\' || op] ELSE list_filter(list_transform(regexp_extract_all(chunk, '[a-zA-Z0-9]+'), lambda x: lower(x)), lambda x: x NOT IN {STOPS}) END AS l FROM told), "
    "words AS (SELECT query_id, c, generate_subscripts(l, 1) AS k, unnest(l) AS s FROM parts), "
    f"voc AS (SELECT DISTINCT s FROM words WHERE NOT starts_with(s, '\\')), {stem_ctes()} "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c, k) - 1 AS pos, coalesce(term, s) AS token FROM words LEFT JOIN stems USING (s)"
)


@register(_TOKENS_SQL)
def query_tokens(spark, d):
    """The words of queries, split and stemmed by Spark itself, as a batch would be."""
    raw = spark.createDataFrame(_RAW, "query_id int, query string")
    chunks = raw.select("query_id", F.posexplode(F.split(F.trim("query"), r"\s+")).alias("c", "chunk"))
    operator = F.regexp_extract(F.lower("chunk"), r"^\\?(and|or|not)$", 1)
    chunks = chunks.withColumn("op", operator)
    words = chunks.select("query_id", "c", F.posexplode(F.when(F.col("op") != "", F.array(F.concat(F.lit("\\"), "op"))).otherwise(text.surface_tokens(F.col("chunk")))).alias("k", "word"))
    terms = with_stem(words, "word", "token").withColumn("token", F.when(F.col("word").startswith("\\"), F.col("word")).otherwise(F.col("token")))
    order = Window.partitionBy("query_id").orderBy("c", "k")
    return terms.select("query_id", (F.row_number().over(order) - 1).alias("pos"), "token")


# --- encoding ---


@register(indexed("SELECT term, pos, gap FROM gaps", GAPS))
def posting_gaps(spark, d):
    return codec.gaps(held(spark, d).postings)


@register(indexed("SELECT term, doc_id FROM postings"))
def gap_cumsum(spark, d):
    return codec.ungapped(codec.gaps(held(spark, d).postings))


_BYTES = "CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END"
_HEX = "CASE WHEN gap < 128 THEN printf('%02X', gap + 128) WHEN gap < 16384 THEN printf('%02X', gap % 128) || printf('%02X', gap // 128 + 128) ELSE printf('%02X', gap % 128) || printf('%02X', gap // 128 % 128) || printf('%02X', gap // 16384 + 128) END"


@register(indexed(f"SELECT term, count(*) AS df, string_agg({_HEX}, '' ORDER BY pos) AS payload FROM gaps GROUP BY term", GAPS))
def vbyte_encode(spark, d):
    return ix.posting_lists(held(spark, d).postings).select("term", "df", F.hex(codec.vbyte(codec.gap_list(F.col("doc_ids")))).alias("payload"))


@register(indexed("SELECT term, doc_id FROM postings"))
def vbyte_roundtrip(spark, d):
    coded = ix.posting_lists(held(spark, d).postings).select("term", codec.vbyte(codec.gap_list(F.col("doc_ids"))).alias("payload"))
    return coded.select("term", F.explode(codec.ungap_list(codec.unvbyte(F.col("payload")))).alias("doc_id"))


@register(indexed("SELECT p.term, df.df FROM (SELECT term, list(DISTINCT doc_id) AS doc_ids FROM postings GROUP BY term) AS p JOIN df USING (term) WHERE len(p.doc_ids) <> df.df"))
def df_mismatch(spark, d):
    return ix.posting_lists(held(spark, d).postings).where(F.size("doc_ids") != F.col("df")).select("term", "df")


@register(indexed(f"SELECT term, CAST(sum({_BYTES}) AS BIGINT) AS n_bytes FROM gaps GROUP BY term", GAPS))
def posting_bytes(spark, d):
    return codec.gaps(held(spark, d).postings).groupBy("term").agg(F.sum(codec.byte_count(F.col("gap"))).alias("n_bytes"))


# --- aggregations ---


@register(indexed("SELECT term, doc_id FROM postings"))
def postings(spark, d):
    return index(spark, d)


@register(indexed("SELECT term, count(*) AS df, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids FROM postings GROUP BY term"))
def posting_lists(spark, d):
    return ix.posting_lists(held(spark, d).postings).withColumn("doc_ids", F.array_join("doc_ids", ","))


@register(indexed("SELECT term, doc_id // 256 AS block, count(*) AS df, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids FROM postings GROUP BY ALL"))
def posting_blocks(spark, d):
    return ix.posting_blocks(held(spark, d).postings, 256).withColumn("doc_ids", F.array_join("doc_ids", ","))


@register(indexed("SELECT term, df FROM df"))
def doc_frequency(spark, d):
    return ix.document_frequency(held(spark, d).postings)


@register(indexed("SELECT count(*) AS num_terms FROM df"))
def vocab_size(spark, d):
    return held(spark, d).postings.agg(F.countDistinct("term").alias("num_terms"))


@register(indexed("SELECT doc_id FROM universe"))
def universe(spark, d):
    return held(spark, d).universe


@register(indexed("SELECT min(df) AS min_df, list_sort(list(df))[count(*) // 2 + 1] AS median_df, max(df) AS max_df, round(avg(df), 6) AS mean_df FROM df"))
def posting_length_stats(spark, d):
    return stats.posting_length_stats(ix.document_frequency(held(spark, d).postings))


@register(indexed("SELECT round(avg(CASE WHEN df <= 3 THEN 1.0 ELSE 0.0 END) * 100, 6) AS rare_pct, avg(CASE WHEN df <= 3 THEN 1.0 ELSE 0.0 END) * 100 >= 50 AS passed FROM df"))
def rare_term_share(spark, d):
    return stats.rare_term_share(ix.document_frequency(held(spark, d).postings))


@register(indexed("SELECT term, df FROM df WHERE df > (SELECT count(*) FROM documents) // 2"))
def high_freq_terms(spark, d):
    return stats.high_frequency_terms(ix.document_frequency(held(spark, d).postings), docs(spark, d).count())


_STATS = "count({v}) AS n, round(avg({v}), 4) AS mean_ms, round(quantile_cont({v}, 0.5), 4) AS median_ms, round(quantile_cont({v}, 0.95), 4) AS p95_ms, round(quantile_cont({v}, 0.99), 4) AS p99_ms, round(min({v}), 4) AS min_ms, round(max({v}), 4) AS max_ms"


@register(f"SELECT event_type, {_STATS.format(v='value')} FROM events GROUP BY event_type")
def latency_stats(spark, d):
    return stats.sample_stats(events(spark, d), F.col("value"), ["event_type"])


@register("SELECT event_type, round(count(*) / (sum(value) / 1000), 2) AS qps FROM events GROUP BY event_type")
def throughput(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(F.count("*") / (F.sum("value") / 1000), 2).alias("qps"))


@register(f"WITH m AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL) SELECT {_STATS.format(v='v')} FROM m")
def combined_stats(spark, d):
    means = events(spark, d).groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    return stats.sample_stats(means, F.col("v"), [])


# --- queries ---


def _query(name: str, query: str, sql: str, infix: bool = False) -> None:
    register(indexed(sql), name)(lambda spark, d: engine(spark, d).query(query, infix))


_AND, _OR, _U = " INTERSECT ", " UNION ", "SELECT doc_id FROM universe"
_query("q_term", "en", has("en"))
_query("q_missing_term", "zzzunknown", has("zzzunknown"))
_query("q_and", "en er \\and", has("en") + _AND + has("er"))
_query("q_or", "thtion attion \\or", has("thtion") + _OR + has("attion"))
_query("q_not", "en \\not", f"{_U} EXCEPT {has('en')}")
_query("q_not_missing", "zzzunknown \\not", _U)
_query("q_and_chain", "en er \\and es \\and", has("en") + _AND + has("er") + _AND + has("es"))
_query("q_or_chain", "thtion attion \\or ertion \\or", has("thtion") + _OR + has("attion") + _OR + has("ertion"))
_query("q_and_or", "en er \\and thtion \\or", f"({has('en')}{_AND}{has('er')}){_OR}{has('thtion')}")
_query("q_or_and", "en er \\or thtion \\and", f"({has('en')}{_OR}{has('er')}){_AND}{has('thtion')}")
_query("q_and_not", "en er \\not \\and", f"{has('en')} EXCEPT {has('er')}")
_query("q_not_compound", "en er \\and \\not", f"{_U} EXCEPT ({has('en')}{_AND}{has('er')})")
_query("q_four_terms", "en er \\and thtion attion \\or \\and", f"({has('en')}{_AND}{has('er')}){_AND}({has('thtion')}{_OR}{has('attion')})")
_query("q_demorgan", "en \\not er \\not \\or", f"{_U} EXCEPT ({has('en')}{_AND}{has('er')})")
_query("q_infix", "(thtion OR attion) AND en NOT er", f"(({has('thtion')}{_OR}{has('attion')}){_AND}{has('en')}) EXCEPT {has('er')}", True)

_BATCH_SQL = {
    0: has("en") + _AND + has("er"), 1: has("es") + _OR + has("th"), 2: f"{_U} EXCEPT {has('nd')}", 4: _U, 5: f"({has('en')}{_AND}{has('er')}) EXCEPT {has('th')}",
    6: f"({has('thtion')}{_OR}{has('attion')}){_AND}{has('ertion')}", 7: f"{_U} EXCEPT (({has('en')}{_OR}{has('er')}){_AND}{has('es')})",
}
_BATCH = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS query_id, doc_id FROM ({sql})" for k, sql in _BATCH_SQL.items())


@register(indexed(_BATCH))
def q_batch(spark, d):
    return engine(spark, d).run_queries(BATCH)[0]


@register(indexed(f"SELECT query_id, string_agg(doc_id, ' ' ORDER BY doc_id) AS result FROM ({_BATCH}) GROUP BY query_id"))
def format_results(spark, d):
    return formatted(q_batch(spark, d))


@register(indexed(f"({has('en')}{_OR}{has('thtion')}) EXCEPT {has('er')}"))
def q_relational(spark, d):
    found = engine(spark, d)
    return relational(found.index, found.parse("en thtion \\or er \\not \\and"), found.universe)


@register(indexed(f"{has('en')}{_AND}{has('er')}"))
def flagship(spark, d):
    return engine(spark, d).query("en er \\and")


@register(indexed(f"({_U} EXCEPT {has('en')}){_OR}{has('thtion')}"))
def q_sharded(spark, d):
    """Each shard answers from its own universe; the union is the answer. One plan does it, keyed by shard."""
    stored, n = held(spark, d), docs(spark, d).count()
    shard = ix.shard_of(F.col("doc_id"), F.lit(n), 4).alias("shard")
    program = engine(spark, d).parse("en \\not thtion \\or")
    answers = one_scan(stored.postings.select("term", "doc_id", shard), program, stored.universe.select("doc_id", shard), ("shard", "doc_id"))
    return answers.select("doc_id")


@register("SELECT doc_id, least(doc_id // greatest(1, (SELECT count(*) FROM documents) // 4), 3) AS shard FROM documents")
def shard_assign(spark, d):
    return ix.with_shards(docs(spark, d).select("doc_id"), 4)


@register(indexed("SELECT DISTINCT term, least(doc_id // greatest(1, (SELECT count(*) FROM documents) // 4), 3) AS shard FROM postings"))
def shard_catalog(spark, d):
    shard = ix.shard_of(F.col("doc_id"), F.lit(docs(spark, d).count()), 4)  # what with_shards() gives the documents
    return ix.shard_catalog(held(spark, d).postings.withColumn("shard", shard))


@register(indexed(f"{has('thtion')}{_AND}({_U} EXCEPT {has('en')})"))
def q_routed(spark, d):
    """Only shards whose catalog has the term are read."""
    n = docs(spark, d).count()
    sharded = held(spark, d).postings.withColumn("shard", ix.shard_of(F.col("doc_id"), F.lit(n), 4))
    program = engine(spark, d).parse("thtion en \\not \\and")
    return routed(sharded, ix.shard_catalog(sharded), program).select("doc_id")


RANKED = ["thtion", "attion", "ertion"]
_CHOSEN = "chosen AS (SELECT * FROM tf WHERE term IN ('thtion', 'attion', 'ertion')), cdf AS (SELECT term, count(*) AS df FROM chosen GROUP BY term), lens AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id)"


def _top(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(k)


@register(f"WITH {TF}, {_CHOSEN} SELECT doc_id, round(sum(tf * ln((SELECT count(*) FROM documents) / df)), 6) AS score FROM chosen JOIN cdf USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def tfidf_topk(spark, d):
    return _top(ix.tfidf(held(spark, d).tf, RANKED, docs(spark, d).count()))


@register(f"WITH {TF}, {_CHOSEN} SELECT doc_id, round(sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lens)))), 6) AS score FROM chosen JOIN cdf USING (term) JOIN lens USING (doc_id) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    stored = held(spark, d)
    return _top(ix.bm25(stored.tf, RANKED, docs(spark, d).count(), lengths=stored.documents))


# --- checks ---


@register("SELECT count(*) AS n_docs, max(doc_id) + 1 AS n_ids, count(*) = max(doc_id) + 1 AS dense FROM documents")
def chk_doc_count(spark, d):
    n, ids = F.count("*"), F.max("doc_id") + 1
    return docs(spark, d).agg(n.alias("n_docs"), ids.alias("n_ids"), (n == ids).alias("dense"))


@register(indexed("SELECT count(*) FILTER (WHERE l <> list_sort(l)) AS unsorted, count(*) FILTER (WHERE len(l) <> len(list_distinct(l))) AS repeated, count(*) FILTER (WHERE list_min(l) < 0) AS negative, count(*) FILTER (WHERE list_max(l) >= (SELECT count(*) FROM documents)) AS too_large, count(*) FILTER (WHERE len(l) <> df.df) AS df_mismatch FROM (SELECT term, list(doc_id ORDER BY doc_id) AS l FROM postings GROUP BY term) JOIN df USING (term)"))
def chk_posting_invariants(spark, d):
    return stats.posting_invariants(ix.posting_lists(held(spark, d).postings), docs(spark, d).count())


@register(indexed("SELECT count(*) FILTER (WHERE term = '') AS empty_terms, count(*) FILTER (WHERE term IN ('the', 'a', 'an', 'is', 'in', 'of', 'and', 'to', 'it', 'for')) AS stop_words FROM postings"))
def chk_stopwords_absent(spark, d):
    return held(spark, d).postings.agg(F.count_if(F.col("term") == "").alias("empty_terms"), F.count_if(F.col("term").isin(*"the a an is in of and to it for".split())).alias("stop_words"))


EXPECTED = [("en", 2), ("er", 2), ("thtion", 1), ("zzzunknown", 1)]


@register(indexed("SELECT e.term, e.least, coalesce(df.df, 0) AS df, coalesce(df.df, 0) >= e.least AS ok FROM (VALUES " + ", ".join(f"('{t}', CAST({n} AS BIGINT))" for t, n in EXPECTED) + ") AS e(term, least) LEFT JOIN df USING (term)"))
def chk_expected_terms(spark, d):
    expected = spark.createDataFrame(EXPECTED, "term string, least long")
    found = ix.document_frequency(held(spark, d).postings.where(F.col("term").isin(*[t for t, _ in EXPECTED])))
    return expected.join(found, "term", "left").select("term", "least", F.coalesce("df", F.lit(0)).alias("df"), (F.coalesce("df", F.lit(0)) >= F.col("least")).alias("ok"))


@register(indexed("SELECT term, df FROM df WHERE df BETWEEN 3 AND 20 ORDER BY df DESC, term LIMIT 2"))
def topk_mid_freq_terms(spark, d):
    return stats.mid_frequency_terms(ix.document_frequency(held(spark, d).postings))


@register(indexed(f"SELECT 'x' AS side, count(*) AS n FROM ({has('en')}) UNION ALL SELECT 'not x', count(*) FROM ({_U} EXCEPT {has('en')}) UNION ALL SELECT 'both', 0 UNION ALL SELECT 'either', count(*) FROM universe"))
def chk_complement(spark, d):
    found = engine(spark, d)
    sides = {"x": "en", "not x": "en \\not", "both": "en en \\not \\and", "either": "en en \\not \\or"}
    answers = batch(found.index, {k: found.parse(q) for k, q in enumerate(sides.values())}, found.universe)
    counts = answers.groupBy("query_id").agg(F.count("*").alias("n"))
    names = spark.createDataFrame(list(enumerate(sides)), "query_id long, side string")
    return names.join(counts, "query_id", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


# --- reports ---


def _phases(spark, d) -> DataFrame:
    return stats.sample_stats(events(spark, d).withColumn("phase", F.col("event_id") % 3 + 1), F.col("value"), ["event_type", "phase"])


_PHASES = f"p AS (SELECT event_type, event_id % 3 + 1 AS phase, {_STATS.format(v='value')} FROM events GROUP BY ALL)"
_FIRST = "first_value(median_ms) OVER (PARTITION BY event_type ORDER BY phase)"


@register(f"WITH {_PHASES} SELECT * FROM p")
def phase_summary(spark, d):
    return _phases(spark, d)


@register(f"WITH {_PHASES} SELECT event_type, phase, median_ms, round(CASE WHEN {_FIRST} <> 0 THEN (median_ms - {_FIRST}) / {_FIRST} * 100 ELSE 0 END, 4) AS delta_pct FROM p")
def phase_delta(spark, d):
    return stats.against_first(_phases(spark, d), "event_type", "phase", "median_ms").drop("speedup")


@register(f"WITH {_PHASES} SELECT event_type, phase, median_ms, round(CASE WHEN median_ms <> 0 THEN {_FIRST} / median_ms ELSE 0 END, 4) AS speedup FROM p")
def speedup(spark, d):
    return stats.against_first(_phases(spark, d), "event_type", "phase", "median_ms").drop("delta_pct")


@register(f"WITH {_PHASES}, w AS (SELECT event_type, max(median_ms) FILTER (WHERE phase = 1) AS phase_1, max(median_ms) FILTER (WHERE phase = 2) AS phase_2, max(median_ms) FILTER (WHERE phase = 3) AS phase_3 FROM p GROUP BY event_type) SELECT *, round(CASE WHEN phase_1 <> 0 THEN (phase_3 - phase_1) / phase_1 * 100 WHEN phase_1 = 0 THEN 0 END, 4) AS delta_pct FROM w")
def phase_table(spark, d):
    return stats.cross_phase(_phases(spark, d), "event_type", "phase", "median_ms", [1, 2, 3])
