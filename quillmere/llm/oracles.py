"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .rules import FENCE, GRID, GROUP_ROWS, LOWER, NOT_PUNCTUATION, SPARSE, UPPER

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, k, unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM h, unnest(range(0, n)) AS t(o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_VALUES = {
    "length": f"least(word_chars * 100 // n_words, {GRID})",
    "punctuation": f"least(n_punctuation * {GRID} // word_chars, {GRID})",
    "variety": f"CAST(floor({GRID} * ln(n_distinct) / ln(n_words) + 1e-6) AS BIGINT)",
    "repeated": f"least(n_repeat_words * {GRID} // n_words, {GRID})",
    "lines": f"least(n_dup_lines * {GRID} // n_lines, {GRID})",
}
_POINTS = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS what, {v} AS spot FROM g WHERE NOT base_failed" for k, v in _VALUES.items())
_NAMES = lambda names: ", ".join(f"'{x}'" for x in names)


def _quartiles(name: str, keys: str) -> str:
    by = f"{keys}, what" if keys else "what"
    return (
        f"{name}r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY spot) AS up_to, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, spot, count(*) AS n FROM p WHERE spot > 0 OR what NOT IN ({_NAMES(SPARSE)}) GROUP BY {by}, spot)), "
        f"{name}q AS (SELECT {by}, max(total) AS total, min(spot) FILTER (up_to * 4 >= total) AS q1, min(spot) FILTER (up_to * 4 >= total * 2) AS q2, min(spot) FILTER (up_to * 4 >= total * 3) AS q3 FROM {name}r GROUP BY {by}), "
        f"{name} AS (SELECT {by}, total, CASE WHEN what IN ({_NAMES(SPARSE)}) THEN q3 * q3 // q2 ELSE q3 + {FENCE} * (q3 - q2) END AS hi, q1 - {FENCE} * (q2 - q1) AS lo FROM {name}q)"
    )


def _level(bound: str) -> str:
    return f"CASE WHEN o.total >= {GROUP_ROWS} THEN o.{bound} WHEN t.total >= {GROUP_ROWS} THEN t.{bound} WHEN a.total >= {GROUP_ROWS} THEN a.{bound} END AS {bound}"


OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS ls FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS t(i)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM e), unnest(range(0, 8)) AS t(o) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '{NOT_PUNCTUATION}', '', 'g')) AS n_punctuation, len(list_distinct(w)) AS n_distinct FROM d LEFT JOIN r USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
p AS ({_POINTS}),
{_quartiles("own", "lang, source")}, {_quartiles("tongue", "lang")}, {_quartiles("every", "")},
k AS (SELECT DISTINCT lang, source, what FROM p),
lim AS (SELECT k.lang, k.source, k.what, {_level("hi")}, {_level("lo")}
  FROM k LEFT JOIN own o ON o.lang = k.lang AND o.source = k.source AND o.what = k.what LEFT JOIN tongue t ON t.lang = k.lang AND t.what = k.what LEFT JOIN every a ON a.what = k.what),
v AS (SELECT doc_id, bool_and((p.what NOT IN ({_NAMES(UPPER)}) OR coalesce(spot <= hi, true)) AND (p.what NOT IN ({_NAMES(LOWER)}) OR coalesce(spot >= lo, true))) AS inside
  FROM p JOIN lim ON lim.lang = p.lang AND lim.source = p.source AND lim.what = p.what GROUP BY doc_id)
SELECT g.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM g LEFT JOIN v ON v.doc_id = g.doc_id
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACE}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.id),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.id = d.doc_id
"""
