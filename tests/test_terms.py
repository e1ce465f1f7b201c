import re

import pyarrow as pa

from lexmill.functions import terms
from lexmill.functions.stem import stem
from lexmill.functions.text import STOP_WORDS
from lexmill.operators import index as ix

TEXTS = ["Running runs, the RUNNER's café Kelvin doing", "", None, "the and of", "Skies-sky 42 42 under_score\nbeing", "same same thereing"]


def tokens(text):
    return [x for x in (w.lower() for w in re.findall("[a-zA-Z0-9]+", text or "")) if x not in STOP_WORDS]


def test_terms_of_texts(spark):
    docs = spark.createDataFrame([(k if k else None, x) for k, x in enumerate(TEXTS)], "doc_id int, text string").coalesce(1)
    want = [(k or None, pos, stem(w)) for k, x in enumerate(TEXTS) for pos, w in enumerate(tokens(x)) if stem(w) not in STOP_WORDS]
    assert sorted(map(repr, map(tuple, ix.normalized(docs).collect()))) == sorted(map(repr, want))
    count = {}
    for k, _, t in want:
        count[t, k] = count.get((t, k), 0) + 1
    assert {(r.term, r.doc_id): r.tf for r in ix.term_frequencies(docs).collect()} == count
    assert sorted(map(repr, map(tuple, ix.postings(docs).collect()))) == sorted(map(repr, count))
    assert ix.postings(docs).schema["doc_id"].dataType.simpleString() == "int"
    assert sorted(r.term for r in ix.distinct_terms(docs).collect()) == sorted({t for t, _ in count})


def test_terms_of_a_text_in_pieces(monkeypatch):
    monkeypatch.setattr(terms, "TEXT_AT_ONCE", 7)
    text = " ".join(f"word{k % 5}x" for k in range(40)) + "longerthanapiece" * 3
    words = terms.Words(False, True)
    assert [words.terms[k] for k in words.of(text.encode())] == [stem(w) for w in text.split()]


def test_recurring_documents_and_no_shuffle(spark, tmp_path):
    rows = [(1, "alpha beta"), (1, "alpha alpha"), (2, "beta"), (None, "beta"), (None, "beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in ix.term_frequencies(docs).collect()} == {("alpha", 1, 3), ("beta", 1, 1), ("beta", 2, 1), ("beta", None, 2)}
    stored = ix.store_index(docs, str(tmp_path / "index"))
    assert ix.postings(docs).count() == 4 and {tuple(r) for r in stored.documents.collect()} == {(1, 4), (2, 1), (None, 2)}
    assert sorted(x.name for x in (tmp_path / "index").iterdir()) == ["documents", "tf"]
    for found in (ix.postings(docs.limit(0)), ix.normalized(docs), ix.postings(docs.where("text = 'beta' and doc_id is not null"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "hashpartitioning" not in plan


def test_terms_of_few_held_words(spark, monkeypatch):
    monkeypatch.setattr(terms, "WORDS_HELD", 3)
    monkeypatch.setattr(terms, "TEXT_AT_ONCE", 20)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["one two three four", "four five six seven", "one seven"]})
    got = [(ids[int(r)].as_py(), w.terms[c]) for ids, w, rows, codes in terms._blocks(iter([batch]), False, True) for r, c in zip(rows, codes) if c >= 0]
    assert got == [(k, stem(w)) for k, x in zip([1, 2, 3], ["one two three four", "four five six seven", "one seven"]) for w in tokens(x) if stem(w) not in STOP_WORDS]
