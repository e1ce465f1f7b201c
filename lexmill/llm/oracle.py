"""DuckDB SQL that says the same as those of the subpackage's queries that SQL can express, written apart from their code."""

from __future__ import annotations

from lexmill.llm.url_filter import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = rf"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM texts),
k AS (SELECT *, trim(line) AS t, len(regexp_extract_all(line, '{WORD}')) AS c FROM l),
ahead AS (SELECT *, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(c, 1) OVER w AS c1 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
    SELECT doc_id, i, 3 AS size, [t, t1, t2] AS key FROM ahead WHERE i + 2 <= n
    UNION ALL SELECT doc_id, i, 2, [t, t1] FROM ahead WHERE i + 1 <= n AND c + c1 >= 50
    UNION ALL SELECT doc_id, i, 1, [t] FROM ahead WHERE c >= 50),
later AS (SELECT doc_id, i, size FROM (SELECT *, row_number() OVER (PARTITION BY size, key ORDER BY doc_id, i) AS r FROM runs) WHERE r > 1),
short AS (SELECT doc_id, list(t ORDER BY i) AS key FROM k WHERE n < 3 GROUP BY doc_id HAVING sum(c) > 0),
copies AS (SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r FROM short) WHERE r > 1),
gone AS (
    SELECT DISTINCT doc_id, i FROM (
        SELECT doc_id, unnest(range(i, i + size)) AS i FROM later UNION ALL SELECT k.doc_id, k.i FROM k JOIN copies USING (doc_id))),
kept AS (
    SELECT k.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE gone.i IS NULL), '') AS left_over
    FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.i = gone.i GROUP BY k.doc_id)
SELECT d.doc_id, CASE WHEN kept.n_removed > 0 THEN left_over ELSE d.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents AS d LEFT JOIN kept USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e AS x JOIN e AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reached.a, ways.b FROM reached JOIN ways ON reached.b = ways.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(reached.b) AS component_id FROM s JOIN reached ON reached.a = s.doc_id GROUP BY ALL
"""

_RULES = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in _RULES]


def _level(name: str, key: str, rows: str, prior: str, up: str = "") -> str:
    """CTEs of the posteriors a, b of a level, whose rows have n, bad and a prior."""
    return f"""
{name}_p AS (SELECT x.*, {prior} AS prior FROM ({rows}) AS x {up}),
{name}_m AS (
    SELECT CASE WHEN coalesce(room, 0) <> 0 THEN 1 / least(0.999, greatest(0.001, (ss - one) / room)) - 1 ELSE 1.0 END AS m FROM (
        SELECT sum(n * power(bad / n - prior, 2)) AS ss, sum(prior * (1 - prior)) AS one, sum((n - 1) * prior * (1 - prior)) AS room FROM {name}_p WHERE n > 0)),
{name} AS (SELECT x.*, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM {name}_p AS x, {name}_m)"""


URLS = rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
marks AS (
    SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
told AS (SELECT p.*, marks.bad FROM p LEFT JOIN marks ON marks.doc_id = try_cast(nullif(regexp_extract(path, '/(\d{{1,18}})(?:\.html|/)?$', 1), '') AS BIGINT)),
hosts AS (
    SELECT host, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(bad) AS n, coalesce(sum(bad), 0) AS bad
    FROM told GROUP BY host),
overall AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS share FROM hosts),
{_level("tops", "suffix", "SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix", "(SELECT share FROM overall)")},
{_level("middles", "domain", "SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL", "y.a / (y.a + y.b)", "JOIN tops AS y USING (suffix)")},
{_level("ends", "host", "SELECT host, domain, n, bad FROM hosts", "y.a / (y.a + y.b)", "JOIN middles AS y USING (domain)")},
low AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ends)
SELECT page_id, p.host, path, CASE {" ".join(f"{fit} '{h}{x}'" for fit, (h, x, _) in zip(_FITS, _RULES, strict=True))} END AS rule,
    CASE {" ".join(f"{fit} '{v}'" for fit, (_, _, v) in zip(_FITS, _RULES, strict=True))} WHEN low > (SELECT share FROM overall) THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN low ON p.host = low.host
""".replace("FROM p JOIN", "FROM p JOIN").replace("(host = ", "(p.host = ").replace("ends_with(host,", "ends_with(p.host,")
