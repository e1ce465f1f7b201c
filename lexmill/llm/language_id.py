"""Language ID by cross-parsing entropy: longest matches in a suffix automaton of each language's labelled text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm.common import blocks_of, fold

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence (codes 1..symbols; 0 ends a document): state x code -> state.

    0 is the start and -1 means no transition; code 0 has none, so no match runs across documents.
    """
    size = 2 * len(text) + 2
    step = np.full((size, symbols + 1), -1, np.int32)
    link, length = [-1] * size, [0] * size
    rows: list[dict[int, int]] = [{}]
    last = 0
    for c in text.tolist():
        if c == 0:
            last = 0
            continue
        if c in rows[last]:  # a generalised automaton: the document may repeat an earlier one
            q = rows[last][c]
            if length[q] == length[last] + 1:
                last = q
                continue
            clone = len(rows)
            rows.append(dict(rows[q]))
            length[clone], link[clone], link[q] = length[last] + 1, link[q], clone
            p = last
            while p != -1 and rows[p].get(c) == q:
                rows[p][c] = clone
                p = link[p]
            last = clone
            continue
        new = len(rows)
        rows.append({})
        length[new] = length[last] + 1
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(rows)
                rows.append(dict(rows[q]))
                length[clone], link[clone] = length[p] + 1, link[q]
                link[q] = link[new] = clone
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = clone
                    p = link[p]
        last = new
    for state, row in enumerate(rows):
        for c, to in row.items():
            step[state, c] = to
    return step[: len(rows)]


OWN = 46  #: letters with a code of their own; the others are written as hexadecimal digits of their code points
DIGITS = 5  #: digits of such a letter
SYMBOLS = 1 + OWN + 16  #: code 1 is any run of what isn't a letter, then letters in either case, then digits


class Model:
    """Automata of all languages over one alphabet, in one table of transitions, and how to parse texts with them.

    Each language is given by up to most_chars codes of its texts. A longer sample has longer matches, by the logarithm of
    its length, so phrases are counted at that weight: languages with little labelled text are on a par.
    """

    def __init__(self, texts: dict[str, list[str]], most_chars: int):
        self.langs = sorted(texts)
        counts: dict[str, int] = {}
        for parts in texts.values():
            for x in parts:
                for c in x.lower():
                    if c.isalpha():
                        counts[c] = counts.get(c, 0) + 1
        #: codes of code points; 0 stands for a letter in digits
        self.code_of = np.array([not chr(c).isalpha() for c in range(0x110000)], np.uint8)
        for k, c in enumerate(sorted(sorted(counts, key=lambda c: (-counts[c], c))[:OWN]), 1):
            for x in {c, c.upper(), c.lower()}:
                if len(x) == 1:
                    self.code_of[ord(x)] = k + 1
        tables, roots, sizes, at = [], [], [], 0
        for lang in self.langs:
            joined = np.concatenate([np.concatenate((self.codes(x)[0], [0])) for x in texts[lang]])[:most_chars]
            table = automaton(joined, SYMBOLS)
            tables.append(np.where(table < 0, -1, table + at))
            roots.append(at)
            sizes.append(len(joined))
            at += len(table)
        self.step = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)
        self.weight = np.log2(np.maximum(sizes, 16)) if sizes else np.zeros(0)

    def codes(self, text: str, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The codes of a text, runs of non-letters as one, and how many each of its parts (of so many characters) has."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code_of[points]
        lengths = np.array([len(points)]) if lengths is None else lengths
        keep = np.ones(len(code), np.int64)
        keep[1:] = (code[1:] != 1) | (code[:-1] != 1)
        starts = np.cumsum(lengths) - lengths
        keep[starts[lengths > 0]] = 1
        rare = code == 0
        keep[rare] = DIGITS
        out = np.repeat(code, keep)
        if rare.any():
            where = np.flatnonzero(np.repeat(rare, keep)).reshape(-1, DIGITS)
            out[where] = 2 + OWN + (points[rare, None] >> (4 * np.arange(DIGITS - 1, -1, -1, dtype=np.uint32)) & 15)
        before = np.concatenate(([0], np.cumsum(keep)))
        return out, before[starts + lengths] - before[starts]

    def codes_of(self, texts: list[str], lengths: np.ndarray, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """codes() of texts one after another, made for about `most` characters at a time: what codes() holds besides is
        many times the codes' own size."""
        at, parts, start = np.cumsum(lengths), [], 0
        while start < len(texts):
            base = at[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(at, base + most, side="right")))
            parts.append(self.codes("".join(texts[start:stop]), lengths[start:stop]))
            start = stop
        return np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])

    def phrases(self, texts: list[str], block: int = 1024, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each text needs in each language (texts x languages), and the number of the texts' codes.

        Texts are parsed greedily into longest matches, in blocks of `block` codes (a phrase ends with its block, which
        adds at most one in `block`); all blocks and languages advance together, a code at a time.
        """
        lengths = np.array([len(x) for x in texts], np.int64)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not self.langs or not lengths.sum():
            return out, lengths
        codes, lengths = self.codes_of(texts, lengths)
        pieces = -(-lengths // block)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(lengths) - lengths)[owner] + nth * block
        size = np.minimum(block, lengths[owner] - nth * block)
        order = np.argsort(-size, kind="stable")
        width = SYMBOLS + 1
        for a in range(0, len(order), lanes):
            part = order[a : a + lanes]
            sizes, starts = size[part], start[part]
            state = np.repeat(self.roots[:, None], len(part), 1)
            count = np.ones(state.shape, np.int32)
            active = len(part)
            roots = self.roots[:, None]
            for t in range(int(sizes[0])):
                while sizes[active - 1] <= t:
                    active -= 1
                c = codes[starts[:active] + t]
                now = state[:, :active]
                to = self.step[now.astype(np.int64) * width + c]
                missed = to < 0
                if missed.any():
                    again = self.step[roots.astype(np.int64) * width + c]  # from the start: a new phrase
                    count[:, :active] += missed
                    to = np.where(missed, np.where(again < 0, roots, again), to)
                state[:, :active] = to
            np.add.at(out, owner[part], count.T)
        return out, lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [x if x and LETTER.search(x) else "" for x in texts]
        phrases, lengths = self.phrases(known)
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.langs:
            rate = phrases * self.weight / np.maximum(lengths, 1)[:, None]
            order = np.argsort(rate, axis=1, kind="stable")
            best = np.take_along_axis(rate, order[:, :1], 1)[:, 0]
            second = np.take_along_axis(rate, order[:, 1:2], 1)[:, 0] if len(self.langs) > 1 else np.ones(len(texts))
            for k in np.flatnonzero(lengths):
                lang[k] = self.langs[order[k, 0]]
                score[k] = float(min(1.0, max(0.0, second[k] / (best[k] + second[k]))))
        return lang, score


def train(docs: DataFrame, docs_a_lang: int = 60, most_chars: int = 30_000, longest: int = 20_000) -> Model:
    """A model of docs(doc_id, text, lang): of each lang, docs_a_lang documents outside fold 2, the first by hash.

    This bounded sample is all that reaches the driver: at most docs_a_lang texts a language, of which most_chars codes go
    into the automaton. Within a language texts of 200 to `longest` characters come first, then shorter ones and the
    beginnings of longer ones, so that a language with only such texts is learned too. The rank filter is pushed below
    the shuffle, so a language with most rows sends docs_a_lang rows from each task. null and empty texts teach nothing;
    equal rows count once.
    """
    rows = docs.where((fold() != 2) & F.col("lang").isNotNull() & (F.length("text") > 0))
    odd = (~F.length("text").between(200, longest)).cast("int")
    order = Window.partitionBy("lang").orderBy("odd", F.xxhash64("doc_id"), "doc_id", "h")
    keys = rows.select("lang", "doc_id", odd.alias("odd"), F.xxhash64("text").alias("h")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_a_lang).drop("n", "odd").distinct()
    wanted = F.broadcast(keys)  # docs_a_lang rows a language
    texts = rows.select("lang", "doc_id", F.left("text", F.lit(longest)).alias("text"), F.xxhash64("text").alias("h"))
    found = texts.join(wanted, texts.lang.eqNullSafe(keys.lang) & texts.doc_id.eqNullSafe(keys.doc_id) & (texts.h == keys.h), "left_semi")
    texts: dict[str, list[str]] = {}
    for r in sorted(set((r.lang, r.doc_id, r.text) for r in found.collect()), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
        texts.setdefault(r[0], []).append(r[2])
    return Model(texts, most_chars)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) with lang_pred and score, which replace columns of these names; each row counts for itself.

    null, empty and letterless texts are `und` with score 0, and so are all without a learned language; of languages with
    equal rates the first by name wins. An empty table gives an empty one. The score is the runner-up's share of both phrase rates:
    0.5 for a tie, near 1 for a clear case. Whole texts are parsed.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches):
        model = held.value
        for batch in batches:
            for part in blocks_of(batch, "text", 1 << 23):
                lang, score = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(work, schema)
