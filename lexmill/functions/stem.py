"""Porter stemming: for words on the driver (queries) and as Column expressions (vocabularies).

Two modes. `porter` is the original rule set; `nltk` has the departures of the NLTK default: irregular forms, `ie` kept
in four-letter words, y to i only after a consonant, `alli` first with step 2 again, `fulli`, `logi` measured with its
l, and two-letter vowel-consonant stems counting as short.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffix rules in the order that decides.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "inning": "inning", "innings": "inning",
    "outing": "outing", "outings": "outing", "canning": "canning", "cannings": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# A leading y is a consonant: it is marked Y, so that [aeiouy] is a vowel everywhere and Y none.
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ONCE, TWICE, EXACTLY = f"^({C})?{V}{C}", f"^({C})?{V}{C}{V}{C}", f"^({C})?{V}{C}({V})?$"
VOWEL, SHORT, TWIN = f"^({C})?[aeiouy]", "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxyY]$", "bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|11|22|33|44|55|66|77|88|99|00"


def _made(x):
    """What stands for a test or value: itself, or what a function of nothing gives."""
    return x() if callable(x) else x


@lru_cache
def _endings(rules: tuple) -> tuple[str, ...]:
    return tuple(s for s, _ in rules)


class _Words:
    """Operations on a Python string, with the names that _Columns gives them on a Column. Only what is needed is worked out."""

    def ends(self, w, suffix):
        return w.endswith(suffix)

    def cut(self, w, n):
        return w[: len(w) - n]

    def fits(self, w, pattern):
        return re.search(pattern, w) is not None

    def add(self, w, suffix):
        return w + suffix

    def size(self, w):
        return len(w)

    def choose(self, cases, otherwise):
        return next((_made(value) for test, value in cases if _made(test)), otherwise)

    def swap(self, w, rules, test):
        for s, to in rules if w.endswith(_endings(rules)) else ():
            if w.endswith(s):
                stem = w[: len(w) - len(s)]
                return stem + to if test(stem, s) else w
        return w

    def both(self, *tests):
        return all(_made(x) for x in tests)

    def either(self, *tests):
        return any(_made(x) for x in tests)

    def no(self, test):
        return not test

    def then(self, w, step):
        return step(w)


class _Columns:
    def ends(self, w, suffix):
        return w.endswith(suffix)

    def cut(self, w, n):
        return F.left(w, F.length(w) - n) if n else w

    def fits(self, w, pattern):
        return w.rlike(pattern)

    def add(self, w, suffix):
        return F.concat(w, F.lit(suffix)) if suffix else w

    def size(self, w):
        return F.length(w)

    def choose(self, cases, otherwise):
        first, *rest = [(_made(test), _made(value)) for test, value in cases]
        return reduce(lambda out, x: out.when(*x), rest, F.when(*first)).otherwise(otherwise)

    def swap(self, w, rules, test):
        cases = [(self.ends(w, s), self.choose([(test(self.cut(w, len(s)), s), self.add(self.cut(w, len(s)), to))], w)) for s, to in rules]
        return self.choose(cases, w)

    def both(self, *tests):
        return reduce(lambda a, b: a & b, map(_made, tests))

    def either(self, *tests):
        return reduce(lambda a, b: a | b, map(_made, tests))

    def no(self, test):
        return ~test


def _steps(o, nltk: bool):
    """The steps as functions of a word, for either kind of operations."""

    def short(w):
        exact = o.both(lambda: o.fits(w, EXACTLY), lambda: o.fits(w, SHORT))
        return o.either(exact, lambda: o.fits(w, "^[aeiouy][^aeiouy]$")) if nltk else exact

    swap = o.swap
    step_2_rules, step_3_rules, step_4_rules = tuple(STEP_2), tuple(STEP_3), tuple((s, "") for s in STEP_4)
    others = [(s, to) for s, to in STEP_2 if s != "alli"]
    step_2_nltk = (*others[:-1], ("fulli", "ful"), others[-1])

    def step_1a(w):
        ies = o.choose([(o.size(w) == 4, o.cut(w, 1))], o.cut(w, 2)) if nltk else o.cut(w, 2)
        return o.choose([(o.ends(w, "sses"), o.cut(w, 2)), (o.ends(w, "ies"), ies), (o.ends(w, "ss"), w), (o.ends(w, "s"), o.cut(w, 1))], w)

    def mended(w):
        again = o.either(o.ends(w, "at"), o.ends(w, "bl"), o.ends(w, "iz"))
        return o.choose([(again, o.add(w, "e")), (lambda: o.fits(w, f"({TWIN})$"), o.cut(w, 1)), (o.either(o.ends(w, "ll"), o.ends(w, "ss"), o.ends(w, "zz")), w), (lambda: short(w), o.add(w, "e"))], w)

    def step_1b(w):
        ied = [(o.ends(w, "ied"), o.choose([(o.size(w) == 4, o.cut(w, 1))], o.cut(w, 2)))] if nltk else []

        def eed():
            return o.choose([(o.fits(o.cut(w, 3), ONCE), o.cut(w, 1))], w)

        def cut(s):
            return o.both(o.ends(w, s), lambda: o.fits(o.cut(w, len(s)), VOWEL)), lambda: mended(o.cut(w, len(s)))

        return o.choose([*ied, (o.ends(w, "eed"), eed), cut("ed"), cut("ing")], w)

    def step_1c(w):
        stem = o.cut(w, 1)


        def test():
            return o.both(o.size(stem) > 1, o.fits(stem, "([^aeiouy]|[aeiou]y)$")) if nltk else o.fits(stem, VOWEL)

        return o.choose([(o.both(o.ends(w, "y"), test), o.add(stem, "i"))], w)

    def step_2(w):
        if not nltk:
            return swap(w, step_2_rules, lambda stem, _: o.fits(stem, ONCE))
        return swap(w, step_2_nltk, lambda stem, s: o.fits(o.add(stem, "l") if s == "logi" else stem, ONCE))

    def alli(w):
        return o.choose([(o.both(o.ends(w, "alli"), lambda: o.fits(o.cut(w, 4), ONCE)), o.cut(w, 2))], w)

    def step_3(w):
        return swap(w, step_3_rules, lambda stem, _: o.fits(stem, ONCE))

    def step_4(w):
        return swap(w, step_4_rules, lambda stem, s: o.both(lambda: o.fits(stem, TWICE), lambda: o.fits(stem, "[st]$")) if s == "ion" else o.fits(stem, TWICE))

    def step_5a(w):
        stem = o.cut(w, 1)

        def test():
            return o.either(lambda: o.fits(stem, TWICE), lambda: o.both(lambda: o.fits(stem, EXACTLY if not nltk else ONCE), lambda: o.no(short(stem))))

        return o.choose([(o.both(o.ends(w, "e"), test), stem)], w)

    def step_5b(w):
        return o.choose([(o.both(o.ends(w, "ll"), lambda: o.fits(o.cut(w, 1), TWICE)), o.cut(w, 1))], w)

    return [step_1a, step_1b, step_1c, *([alli] if nltk else []), step_2, step_3, step_4, step_5a, step_5b]


@lru_cache
def _word_steps(nltk: bool):
    return _steps(_Words(), nltk)


def stem(word: str, nltk: bool = False) -> str:
    """The stem of one folded word."""
    if nltk and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    for step in _word_steps(nltk):
        w = step(w)
    return w.replace("Y", "y")


def with_stem(words: DataFrame, word: str, out: str = "stem", nltk: bool = False) -> DataFrame:
    """words with the stem of a column of folded words.

    Each step is a lambda over a one-element array: its word is a variable, so that the expression stays small even
    where the optimizer copies it (nested references to a column would double with each step).
    """
    state: Column = F.array(F.regexp_replace(word, "^y", "Y"))
    for step in _steps(_Columns(), nltk):
        state = F.transform(state, step)
    stemmed = F.when(F.length(word) <= 2, F.col(word)).otherwise(F.regexp_replace(state[0], "Y", "y"))
    for irregular, to in IRREGULAR.items() if nltk else ():
        stemmed = F.when(F.col(word) == irregular, to).otherwise(stemmed)
    return words.withColumn(out, stemmed)
