"""DuckDB SQL that says the same as the registered queries, written apart from the Spark code."""

from __future__ import annotations

# The stop words, as above all in lexmill.functions.text.
STOPS = "('" + "','".join(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with about above after again all am any because been before being below between both can could did do does doing down during each few from further get got had has have having he her here hers herself him himself his how i its itself just me might more most must my myself nor now off once only other our ours ourselves out over own re same she should so some still than them themselves those through too under until up very we were what when where which while who whom why would you your yours yourself yourselves".split()
) + "')"

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M1, _M2, _MX = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
_VOW, _CVC = f"^(?:{_C})?[aeiouy]", "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxyY]$"


def _re(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern}')"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})" if n else "w"


def _rules(rules: str, pattern: str) -> str:
    out = "CASE"
    for rule in rules.split():
        suffix, to = rule.split(":")
        stem = _cut(len(suffix))
        test = _re(stem, pattern) + (f" AND {_re(stem, '[st]$')}" if suffix == "ion" else "")
        out += f" WHEN suffix(w, '{suffix}') THEN CASE WHEN {test} THEN {stem} || '{to}' ELSE w END"
    return out + " ELSE w END"


def stem_ctes() -> str:
    mend = (
        f"CASE WHEN {_re('x', '(at|bl|iz)$')} THEN x || 'e' WHEN {_re('x', '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|00|11|22|33|44|55|66|77|88|99)$')} THEN left(x, length(x) - 1) "
        f"WHEN {_re('x', '(ll|ss|zz)$')} THEN x WHEN {_re('x', _MX)} AND {_re('x', _CVC)} THEN x || 'e' ELSE x END"
    )
    # The suffix rules, as in lexmill.functions.stem.
    steps = [
        "CASE WHEN suffix(w, 'sses') THEN left(w, length(w) - 2) WHEN suffix(w, 'ies') THEN left(w, length(w) - 2) WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END",
        None,  # ed and ing: below
        f"CASE WHEN suffix(w, 'y') AND {_re(_cut(1), _VOW)} THEN {_cut(1)} || 'i' ELSE w END",
        _rules("ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log", _M1),
        _rules("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", _M1),
        _rules("al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:", _M2),
        f"CASE WHEN suffix(w, 'e') AND ({_re(_cut(1), _M2)} OR ({_re(_cut(1), _MX)} AND NOT {_re(_cut(1), _CVC)})) THEN {_cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {_re(_cut(1), _M2)} THEN {_cut(1)} ELSE w END",
    ]
    out = "s0 AS (SELECT s, CASE WHEN starts_with(s, 'y') THEN 'Y' || s[2:] ELSE s END AS w FROM voc)"
    for k, step in enumerate(steps, 1):
        if step is None:
            # The endings ed and ing leave a stem x that is mended.
            out += f", s{k}a AS (SELECT s, w, CASE WHEN suffix(w, 'eed') THEN NULL WHEN suffix(w, 'ed') AND {_re(_cut(2), _VOW)} THEN {_cut(2)} WHEN suffix(w, 'ing') AND {_re(_cut(3), _VOW)} THEN {_cut(3)} END AS x FROM s{k - 1})"
            out += f", s{k} AS (SELECT s, CASE WHEN x IS NOT NULL THEN {mend} WHEN suffix(w, 'eed') AND {_re(_cut(3), _M1)} THEN {_cut(1)} ELSE w END AS w FROM s{k}a)"
        else:
            out += f", s{k} AS (SELECT s, {step} AS w FROM s{k - 1})"
    return out + f", stems AS (SELECT s, CASE WHEN length(s) <= 2 THEN s ELSE replace(w, 'Y', 'y') END AS term FROM s{len(steps)})"


SURFACE = f"surf AS (SELECT doc_id, lower(t) AS s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9]+')) AS t FROM documents) WHERE lower(t) NOT IN {STOPS}), voc AS (SELECT DISTINCT s FROM surf)"
STEMS = f"{SURFACE}, {stem_ctes()}"
INDEX = f"{STEMS}, postings AS (SELECT DISTINCT term, doc_id FROM surf JOIN stems USING (s) WHERE term NOT IN {STOPS}), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term), universe AS (SELECT DISTINCT doc_id FROM postings)"
TF = f"{STEMS}, tf AS (SELECT term, doc_id, count(*) AS tf FROM surf JOIN stems USING (s) WHERE term NOT IN {STOPS} GROUP BY ALL)"
GAPS = f"{INDEX}, gaps AS (SELECT term, row_number() OVER w - 1 AS pos, doc_id - coalesce(lag(doc_id) OVER w, 0) AS gap, doc_id FROM postings WINDOW w AS (PARTITION BY term ORDER BY doc_id))"


def has(term: str) -> str:
    return f"SELECT doc_id FROM postings WHERE term = '{term}'"


def indexed(select: str, ctes: str = INDEX) -> str:
    return f"WITH {ctes} {select}"
