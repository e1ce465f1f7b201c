import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.functions.stem import stem, with_stem
from lexmill.operators import index as ix

GOLDEN = {
    "cats": "cat", "caresses": "caress", "ponies": "poni", "troubled": "troubl", "running": "run", "happiness": "happi", "relational": "relat", "digitize": "digit",
    "sky": "sky", "skylake": "skylak", "retrieval": "retriev", "information": "inform", "queries": "queri", "university": "univers", "government": "govern",
    "country": "countri", "shared": "share", "day": "dai", "enjoy": "enjoi", "fly": "fly", "ties": "ti", "died": "di", "dying": "dy", "news": "new", "geology": "geologi",
    "one": "on", "agreed": "agre", "falling": "fall", "hopping": "hop", "filing": "file", "adoption": "adopt", "is": "is", "yyyed": "yyy",
}
NLTK = {"day": "day", "enjoy": "enjoy", "fly": "fli", "ties": "tie", "died": "die", "news": "news", "dying": "die", "geology": "geolog", "running": "run"}


def test_stems_of_single_words():
    assert {w: stem(w) for w in GOLDEN if w != "yyyed"} == {w: s for w, s in GOLDEN.items() if w != "yyyed"}
    assert {w: stem(w, nltk=True) for w in NLTK} == NLTK


@pytest.mark.parametrize("nltk", [False, True])
def test_columns_stem_like_single_words(spark, nltk):
    words = sorted({*GOLDEN, *NLTK, "youth", "yes", "yttrium", "feed", "sized", "hissing", "rolling", "controll", "cease", "rationalization", "hopefulli", "generalli", "skies", "a1b2s"})
    got = with_stem(spark.createDataFrame([(w,) for w in words], "w string"), "w", nltk=nltk).collect()
    assert {r.w: r.stem for r in got} == {w: stem(w, nltk) for w in words}


CASES = [
    ("doc 42 has 7 terms", ["doc", "42", "has", "7", "terms"]),
    ("well-known state-of-the-art", ["well", "known", "state", "of", "the", "art"]),
    ("don't", ["don", "t"]),
    ("café résumé naïve", ["caf", "r", "sum", "na", "ve"]),
    ("!@#$%^&*()", []),
    ("", []),
    (None, []),
    ("a" * 10_000, ["a" * 10_000]),
    ("İx Kelvin", ["x", "elvin"]),  # letters whose lower case is ASCII
]


def test_tokenize(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, t string")
    got = {r.k: r.x for r in df.select("k", text.casefold(text.tokenize(F.col("t"))).alias("x")).collect()}
    assert got == {k: [w.lower() for w in want] for k, (_, want) in enumerate(CASES)}


def test_punctuation_and_stop_words(spark):
    df = spark.createDataFrame([(["he-llo", "wo.rld", "hello_world", "45.6", "!!!", "The", "the"],)], "t array<string>")
    row = df.select(text.strip_punctuation(F.col("t")).alias("a"), text.drop_stop_words(F.col("t")).alias("b")).first()
    assert row.a == ["hello", "world", "helloworld", "456", "The", "the"]
    assert row.b == ["he-llo", "wo.rld", "hello_world", "45.6", "!!!", "The"]
    assert len(text.STOP_WORDS) == 130


def test_normalize(spark):
    df = spark.createDataFrame([(0, "...the information! (is) retrieval. information"), (1, "The A Is And"), (2, "others owned getting")], "doc_id long, text string")
    got = sorted((r.doc_id, r.pos, r.term) for r in ix.normalized(df).collect())
    assert [(d, t) for d, _, t in got] == [(0, "inform"), (0, "retriev"), (0, "inform")]
