"""Toxicity: Viterbi decoding of disguised words under a character language model, then a score of the restored text."""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import blocks_of, fold

# What a disguising character may stand for, the likeliest first.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "×": "x", "°": "o", "µ": "u"}
ORDER = 4  #: characters of an n-gram
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIZE = 28  #: 0 is a word's edge, 1 to 26 letters, 27 any other letter

BEAM = 32  #: states that are followed

MARK = r"[^\W_]|[@$!|+€£]"  # a letter, a digit or what may stand for a letter
SPACED = re.compile(rf"(?<![^\W_])(?:{MARK})(?:[ .\-_*]{{1,3}}(?:{MARK})){{2,}}(?![^\W_])")  # marks set apart, three at least
HARD = re.compile(r"[/:=&?%#,;\"{}<>\\\[\])]+")  # what no disguise uses
EDGE = re.compile(r"^[^\w@$€£]+|[^\w@$]+$|[$*!#%&@+]{2,}$")
TWICE = re.compile(r"(.)\1")


def codes_of(word: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27 for c in word]


_CODE = np.zeros(0x110000, np.uint8)
for _c in range(0x110000):
    if (_x := chr(_c)).isalpha():
        _CODE[_c] = ord(_x.lower()) - 96 if len(_x.lower()) == 1 and "a" <= _x.lower() <= "z" else 27


def count_ngrams(texts: list[str]) -> np.ndarray:
    """Counts of ORDER-grams of letter codes over all texts, words set apart by edges; an array of SIZE ** ORDER."""
    codes = _CODE[np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    codes = np.concatenate((np.zeros(ORDER - 1, np.int64), codes, np.zeros(1, np.int64)))
    keys = codes[: len(codes) - ORDER + 1]
    for k in range(1, ORDER):
        keys = keys * SIZE + codes[k : len(codes) - ORDER + 1 + k]
    return np.bincount(keys, minlength=SIZE**ORDER)


def gather(docs: DataFrame) -> np.ndarray:
    """ORDER-gram counts over the whole texts of docs: summed in each task, then by n-gram."""

    def work(batches):
        total = np.zeros(SIZE**ORDER, np.int64)
        for batch in batches:
            for part in blocks_of(batch, "text"):
                total += count_ngrams([x for x in part.column("text").to_pylist() if x])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**ORDER)
    out[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return out


class CharModel:
    """An interpolated (Witten-Bell) character model: log-probability of a code after the ORDER - 1 codes before it."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape((SIZE,) * ORDER).astype(float)
        p = np.full(SIZE, 1 / SIZE)
        for k in range(1, ORDER + 1):  # from unigrams up
            c = n.sum(axis=tuple(range(ORDER - k)))
            total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                weight = np.where(total > 0, total / (total + kinds), 0.0)
                p = weight * np.where(total > 0, c / np.maximum(total, 1), 0.0) + (1 - weight) * p
        self.log = np.log(p).ravel().tolist()

    def step(self, state: int, code: int) -> tuple[int, float]:
        key = state * SIZE + code
        return key % SIZE ** (ORDER - 1), self.log[key]


CHANNEL = {"leet": math.log(0.5), "same": math.log(0.7), "double": math.log(0.3), "drop": math.log(0.2), "other": math.log(0.02), "join": math.log(0.7), "break": math.log(0.3)}


def runs_of(token: str) -> list[tuple[str, str]]:
    """The runs of one character of a token: the character, and its repeats."""
    return re.findall(r"(.)(\1*)", token, re.S)


def options_of(c: str, more: str, breaks: bool) -> list[tuple[str, float]]:
    """What a run of c may stand for, with log-probabilities: the lattice's edges. With breaks, marks set letters apart and
    may also be a blank between words."""
    if breaks and c in " .-_*":
        return [("", CHANNEL["join"]), (" ", CHANNEL["join"] if more else CHANNEL["break"])]
    out: list[tuple[str, float]] = []
    for x in LEET.get(c, ""):
        out += [(x, CHANNEL["leet"])] + ([(x + x, CHANNEL["leet"] + CHANNEL["double"])] if more else [])
    if c.isalpha():
        return out + [(c, CHANNEL["same"])] + ([(c + c, CHANNEL["double"])] if more else [])
    return out + [("", CHANNEL["drop"] if c in " .-_*'’~^" else CHANNEL["other"])]


def decode(token: str, model: CharModel, breaks: bool = False) -> str:
    """The likeliest word behind a disguised token; with breaks, the likeliest words behind one of letters set apart.

    The lattice: each run of one character may stand for one or two of it (more written ones change nothing), each
    leet character for one of its letters, and marks between letters for nothing or, with breaks, for a blank. A state
    holds the last codes; Viterbi keeps the best path into each, and of all states the BEAM best, so that the work is
    linear in a token of any length.
    """
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # score, and the path as (path before, letters)
    for c, more in runs_of(token.lower()):
        options = [(letters, codes_of(letters), cost) for letters, cost in options_of(c, more, breaks)]
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for letters, codes, cost in options:
                s, p = state, score + cost
                for code in codes:
                    s, q = model.step(s, code)
                    p += q
                if s not in after or p > after[s][0]:
                    after[s] = (p, (path, letters))
        best = after if len(after) <= BEAM else dict(heapq.nlargest(BEAM, after.items(), key=lambda x: x[1][0]))
    _, path = max(((p + model.step(s, 0)[1], path) for s, (p, path) in best.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


class Restorer:
    """The restored words of whole texts: lower-cased, disguised ones decoded; a bounded number of those is kept."""

    def __init__(self, model: CharModel, kept: int = 1 << 16):
        self.model, self.most = model, kept
        self.kept: dict[str, tuple[str, ...]] = {}

    def restored(self, token: str, breaks: bool = False) -> tuple[str, ...]:
        """What a token that isn't plain letters stands for. Numbers are decoded too if all of their digits may be letters
        and there are four at least."""
        found = self.kept.get(token)
        if found is None:
            found = ()
            for part in (token,) if breaks else HARD.split(token):
                core = part if breaks else EDGE.sub("", part)
                if core.isalpha() and not TWICE.search(core):
                    found += (core,)
                elif any(map(str.isalpha, core)) or not breaks and len(core) >= 4 and all(c in LEET for c in core):
                    found += tuple(decode(core, self.model, breaks).split())
                elif core and not breaks:
                    found += (core,)
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[token] = found
        return found

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        text, out = text.lower(), set()
        for token in set(text.split()):
            core = token.strip(".,;:?\"'()[]")
            if core.isalpha() and not TWICE.search(core):
                out.add(core)
            else:
                out.update(self.restored(token))
        for run in SPACED.findall(text):
            out.update(self.restored(run, True))
        out.discard("")
        return out


def features(word: str) -> tuple[str, ...]:
    """A word and its beginnings, which its other forms share."""
    return word, f"{word[:4]}~", f"{word[:5]}~"


class Scorer:
    """Logistic regression on the presence of restored words and of their beginnings."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.names = frozenset(weights)
        starts = [x[:-1] for x in weights if x.endswith("~")]
        self.four, self.five = {x for x in starts if len(x) <= 4}, {x for x in starts if len(x) == 5}

    def score(self, words: set[str]) -> float:
        weights = self.weights
        found = words & self.names
        found |= {f"{x}~" for x in ({w[:4] for w in words} & self.four) | ({w[:5] for w in words} & self.five)}
        z = self.bias + sum(weights[x] for x in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[set[str], int]], least: int = 8, rounds: int = 150, l1: float = 5e-4, rate: float = 0.5, most: int = 1000) -> Scorer:
    """L1-regularised logistic regression by proximal gradient steps (FISTA) on features of at least `least` documents, the `most` most telling."""
    if not rows or len({y for _, y in rows}) < 2:
        share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
        return Scorer({}, math.log(share / (1 - share)))
    df: dict[str, list[int]] = {}
    y = np.array([y for _, y in rows], float)
    for k, (words, _) in enumerate(rows):
        for w in words:
            df.setdefault(w, []).append(k)
    vocabulary = sorted(w for w, at in df.items() if len(at) >= least)
    n, pos = len(rows), y.sum()

    def gain(w: str) -> float:
        a = sum(y[df[w]])
        b = len(df[w]) - a
        return abs(math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (n - pos + 1))) * math.sqrt(len(df[w]))

    vocabulary = sorted(vocabulary, key=lambda w: (-gain(w), w))[:most]
    pairs = [(k, j) for j, w in enumerate(vocabulary) for k in df[w]]
    row, col = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    x = np.zeros(len(vocabulary))
    z, bias, t = x.copy(), 0.0, 1.0
    size = np.bincount(row, minlength=n).max() if len(row) else 1
    step = rate * 4 * n / max(1.0, n * min(size, 40) / 10)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, z[col], minlength=n), -30, 30)))
        grad = np.bincount(col, (p - y)[row], minlength=len(x)) / n
        new = z - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t_new * (new - x), new, t_new
        bias -= 2 * (p - y).mean()
    return Scorer({w: float(v) for w, v in zip(vocabulary, x, strict=True) if v}, bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> tuple[CharModel, Scorer]:
    """The character model of all docs(doc_id, text) and a scorer of labels(doc_id, toxic) outside fold 2.

    The scorer is fitted on a bounded sample of `sample` labelled documents, the first by hash, half of each label
    where there are enough; weights of the classes are set right through the bias.
    """
    model = CharModel(gather(docs))
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    chosen = None
    for toxic in sorted(n):
        part = marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return model, Scorer({}, 0.0)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    restorer_model = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        restorer = Restorer(restorer_model.value)
        for batch in batches:
            words = [sorted(restorer.words(x or "")) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    got = sorted((r["doc_id"], r["toxic"], r["words"]) for r in rows.select("doc_id", "toxic", "text").mapInArrow(work, "doc_id long, toxic int, words array<string>").toArrow().to_pylist())
    scorer = fit([({f for w in words for f in features(w)}, int(toxic > 0)) for _, toxic, words in got])
    taken = [sum(1 for x in got if x[1] > 0), sum(1 for x in got if x[1] <= 0)]
    whole = [sum(c for k, c in n.items() if k > 0), sum(c for k, c in n.items() if k <= 0)]
    if all(taken) and all(whole):
        scorer.bias += math.log(whole[0] / whole[1]) - math.log(taken[0] / taken[1])
    return model, scorer


def score(docs: DataFrame, model: CharModel, scorer: Scorer) -> DataFrame:
    """docs(doc_id, text, ...) as (doc_id, score): each row by itself, the whole text.

    null and empty texts get the score of a text without telling words; repeated rows have the same score; whole texts are
    read, however long; extra columns are ignored, and an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast((model, scorer))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def work(batches):
        model, scorer = held.value
        restorer = Restorer(model)
        for batch in batches:
            scores = [scorer.score(restorer.words(x or "")) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, schema)
