"""Terms of texts, worked out where the texts are: nothing is joined, and what isn't asked for isn't shuffled.

Bytes are folded and split; each distinct word is looked up, and stemmed, once a task (as long as the table of its words
isn't full, when it is begun anew).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.functions.stem import stem
from lexmill.functions.text import STOP_WORDS

#: ASCII letters and digits, folded; whatever else is a space. A byte of a longer UTF-8 character is never one of them.
FOLDED = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))
WORDS_HELD = 1 << 18
TEXT_AT_ONCE = 1 << 19  #: bytes
TYPES = {"string": T.StringType(), "long": T.LongType()}
STOPPED, DROPPED = -1, -2  #: a stop word, and a word whose stem is one


class Words(dict):
    """word to the number of its term in .terms, or STOPPED or DROPPED."""

    def __init__(self, nltk: bool, post_stop: bool):
        super().__init__()
        self.nltk, self.post_stop, self.terms, self.numbers = nltk, post_stop, [], {}

    def __missing__(self, word: bytes) -> int:
        folded = word.decode()
        if folded in STOP_WORDS:
            number = STOPPED
        elif (term := stem(folded, self.nltk)) in STOP_WORDS and self.post_stop:
            number = DROPPED
        else:
            number = self.numbers.setdefault(term, len(self.terms))
            if number == len(self.terms):
                self.terms.append(term)
        self[word] = number
        return number

    def of(self, text: bytes | None) -> np.ndarray:
        """The numbers of a text's words in their order; a long text is split piece by piece."""
        if not text:
            return np.zeros(0, np.int32)
        folded, out, at = text.translate(FOLDED), [], 0
        while at < len(folded):
            cut = len(folded) if len(folded) - at <= TEXT_AT_ONCE else folded.find(b" ", at + TEXT_AT_ONCE)
            cut = len(folded) if cut < 0 else cut
            words = folded[at:cut].split()
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = cut
        return out[0] if len(out) == 1 else np.concatenate(out)


def _blocks(batches: Iterator[pa.RecordBatch], nltk: bool, post_stop: bool):
    """(doc_ids, words, row of each word's document, its number) of some rows at a time."""
    words = Words(nltk, post_stop)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        at = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = at[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(at, base + TEXT_AT_ONCE, side="right")))
            if len(words) > WORDS_HELD:
                words = Words(nltk, post_stop)
            codes = [words.of(x) for x in texts.slice(start, stop - start).to_pylist()]
            rows = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
            yield batch.column("doc_id").slice(start, stop - start), words, rows, np.concatenate(codes)
            start = stop


def _mapped(docs: DataFrame, made, columns: str, nltk: bool, post_stop: bool) -> DataFrame:
    """What made(doc_ids, words, rows, codes) gives, by columns: their names with types, doc_id with that of docs."""
    kind = docs.schema["doc_id"].dataType
    fields = [x.split(":") for x in columns.split()]
    schema = T.StructType([T.StructField(name, kind if name == "doc_id" else TYPES[of]) for name, of in fields])

    def run(batches):
        for block in _blocks(batches, nltk, post_stop):
            yield pa.RecordBatch.from_arrays(made(*block), [name for name, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _named(words: Words, codes: np.ndarray) -> pa.Array:
    found, at = np.unique(codes, return_inverse=True)
    return pa.array([words.terms[k] for k in found], pa.string()).take(pa.array(at))


def _counted(words: Words, rows: np.ndarray, codes: np.ndarray):
    """The rows and codes of each pair of a document and a term, and how often it is."""
    kept = codes >= 0
    pairs, n = np.unique(rows[kept] * (len(words.terms) + 1) + codes[kept], return_counts=True)
    return *np.divmod(pairs, len(words.terms) + 1), n


def pairs(docs: DataFrame, nltk: bool = False, post_stop: bool = True) -> DataFrame:
    """(term, doc_id), distinct within each row of docs(doc_id, text)."""

    def made(ids, words, rows, codes):
        rows, codes, _ = _counted(words, rows, codes)
        return [_named(words, codes), ids.take(pa.array(rows))]

    return _mapped(docs, made, "term:string doc_id:", nltk, post_stop)


def counts(docs: DataFrame, nltk: bool = False) -> DataFrame:
    """(term, doc_id, tf) of each row of docs."""

    def made(ids, words, rows, codes):
        rows, codes, n = _counted(words, rows, codes)
        return [_named(words, codes), ids.take(pa.array(rows)), pa.array(n.astype(np.int64))]

    return _mapped(docs, made, "term:string doc_id: tf:long", nltk, True)


def in_order(docs: DataFrame, nltk: bool = False) -> DataFrame:
    """(doc_id, pos, term): terms with their places among the words that aren't stop words."""

    def made(ids, words, rows, codes):
        shown = codes != STOPPED
        rows, codes = rows[shown], codes[shown]
        kept = codes != DROPPED
        pos = np.arange(len(rows)) - np.searchsorted(rows, rows)
        return [ids.take(pa.array(rows[kept])), pa.array(pos[kept].astype(np.int64)), _named(words, codes[kept])]

    return _mapped(docs, made, "doc_id: pos:long term:string", nltk, True)


def distinct_terms(docs: DataFrame, nltk: bool = False) -> DataFrame:
    """(term), distinct. A task gives a term once, as long as its table of words isn't begun anew."""

    def run(batches):
        held, given = None, 0
        for _, words, _, _ in _blocks(batches, nltk, True):
            if words is not held:
                held, given = words, 0
            yield pa.RecordBatch.from_arrays([pa.array(words.terms[given:], pa.string())], ["term"])
            given = len(words.terms)

    return docs.select("doc_id", "text").mapInArrow(run, "term string").distinct()
