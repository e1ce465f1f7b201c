"""Scalar text functions as Column expressions: tokens, case folding, stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-zA-Z0-9]+"

# The stop words.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to
    was will with about above after again all am any because been before being below between both can could did do does
    doing down during each few from further get got had has have having he her here hers herself him himself his how i
    its itself just me might more most must my myself nor now off once only other our ours ourselves out over own re
    same she should so some still than them themselves those through too under until up very we were what when where
    which while who whom why would you your yours yourself yourselves
    """.split()
)


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits; null gives no tokens. Folding comes after: lower() makes ASCII of some other letters."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def casefold(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def strip_punctuation(tokens: Column) -> Column:
    """Tokens without what isn't an ASCII letter or digit; empty ones go."""
    return F.filter(F.transform(tokens, lambda x: F.regexp_replace(x, "[^a-zA-Z0-9]", "")), lambda x: x != "")


def is_stop_word(token: Column) -> Column:
    return token.isin(*sorted(STOP_WORDS))


def drop_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: ~is_stop_word(x))


def surface_tokens(text: Column) -> Column:
    """Folded tokens that aren't stop words, in order, repeats kept."""
    return drop_stop_words(casefold(tokenize(text)))
