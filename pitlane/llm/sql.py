"""SQL twins of the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from pitlane.llm import quality, secrets

_LOWER = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"REGEXP_EXTRACT_ALL({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"REGEXP_EXTRACT_ALL({}, '[^\x20\x09-\x0D]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents),
 i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format(_LOWER)} AS w FROM benchmark),
 win AS (SELECT DISTINCT item, LEAST(LEN(w), 13) AS m, ARRAY_TO_STRING(w[k:k + LEAST(LEN(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, UNNEST(RANGE(1, GREATEST(LEN(w) - 12, 1) + 1)) AS k FROM i WHERE LEN(w) > 0) x),
 own AS (SELECT doc_id, k, m, ARRAY_TO_STRING(w[k:k + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, UNNEST(RANGE(1, LEN(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM win) s WHERE LEN(w) >= m) x),
 hit AS (SELECT own.doc_id, own.k, own.m, win.item FROM own JOIN win ON own.g = win.g AND own.m = win.m),
 pos AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, UNNEST(RANGE(k, k + m)) AS p FROM hit) x GROUP BY doc_id),
 its AS (SELECT doc_id, COUNT(*) AS n, STRING_AGG(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(pos.n, 0) AS n_hit, COALESCE(its.n, 0) AS n_items,
 SHA256(COALESCE(its.s, '')) AS items_sha256, COALESCE(pos.n > 0 AND 20 * pos.n >= LEN(w), FALSE) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""


def _spans(rule: secrets.Rule, place: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, CAST(LIST_SUM(gaps[:k]) + COALESCE(LIST_SUM(hits[:k - 1]), 0) AS BIGINT) AS a,
 CAST(LIST_SUM(gaps[:k]) + LIST_SUM(hits[:k]) AS BIGINT) AS z FROM (
 SELECT doc_id, UNNEST(RANGE(1, LEN(hits) + 1)) AS k, gaps, hits, cores FROM (
 SELECT doc_id, LIST_TRANSFORM(STRING_SPLIT_REGEX(t, '{pattern}'), lambda x: LENGTH(x)) AS gaps,
 LIST_TRANSFORM(REGEXP_EXTRACT_ALL(t, '{pattern}', 0), lambda x: LENGTH(x)) AS hits,
 LIST_TRANSFORM(REGEXP_EXTRACT_ALL(t, '{pattern}', {rule.group}), lambda x: LENGTH(x)) AS cores FROM t) x) y WHERE cores[k] >= {rule.least}"""


_KINDS = ", ".join(f"COUNT(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
_BASE = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
SECRETS = f"""
WITH t AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
 s AS ({' UNION ALL '.join(_spans(r, i) for i, r in enumerate(secrets.RULES))}),
 g AS (SELECT doc_id, {_KINDS},
  STRING_AGG(kind || ':' || a || ':' || z, ',' ORDER BY a, place) FILTER (kind IN ({_BASE})) AS base,
  STRING_AGG(kind || ':' || a || ':' || z, ',' ORDER BY a, place) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f'COALESCE(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)},
 SHA256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""

_CELLS = " UNION ALL ".join(
    f"SELECT doc_id, stratum, '{rule}' AS rule, CAST({a} AS DOUBLE) / NULLIF({b}, 0) AS ratio FROM c"
    for rule, (a, b, _) in quality.RULES.items())
_GRID = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, UNNEST([{', '.join(str(x) for x in grid)}])::DOUBLE AS cutoff" for rule, (_, _, grid) in quality.RULES.items())
_P = f"{quality.RISK}::DOUBLE"
QUALITY = rf"""
WITH b AS (SELECT doc_id, COALESCE(lang, '') AS stratum, COALESCE(text, '') AS t FROM documents),
 w AS (SELECT *, {_SPACED.format('t')} AS w, LIST_FILTER(STRING_SPLIT(t, CHR(10)), lambda x: REGEXP_MATCHES(x, '[^\x20\x09-\x0D]')) AS l FROM b),
 g AS (SELECT doc_id, k, g, COUNT(*) OVER (PARTITION BY doc_id, g) AS n FROM (
  SELECT doc_id, k, ARRAY_TO_STRING(w[k:k + 2], ' ') AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 1)) AS k FROM w WHERE LEN(w) >= 3) x) y),
 r AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, UNNEST(RANGE(k, k + 3)) AS p FROM g WHERE n > 1) x GROUP BY doc_id),
 c AS (SELECT w.doc_id, stratum, CAST(LEN(w) AS BIGINT) AS n_words, CAST(LENGTH(REGEXP_REPLACE(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(LENGTH(t) - LENGTH(TRANSLATE(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(LEN(l) AS BIGINT) AS n_lines,
  CAST(LEN(l) - LEN(LIST_DISTINCT(l)) AS BIGINT) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words,
  CAST(LENGTH(t) - LENGTH(TRANSLATE(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
 x AS ({_CELLS}),
 m AS (SELECT doc_id, MIN(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
 k AS (SELECT x.stratum, gr.rule, gr.cutoff, COUNT(*) FILTER (quality = 1) AS n, COUNT(*) FILTER (quality = 1 AND ratio > cutoff) AS k,
  COUNT(*) FILTER (quality = 0) AS n0, COUNT(*) FILTER (quality = 0 AND ratio > cutoff) AS k0
  FROM x JOIN m ON x.doc_id = m.doc_id JOIN f ON x.doc_id = f.doc_id AND NOT f.base_failed JOIN ({_GRID}) gr ON gr.rule = x.rule GROUP BY ALL HAVING COUNT(*) FILTER (quality = 1) > 0),
 s AS (SELECT *, COUNT(*) OVER () AS tests, CASE WHEN k >= n * {_P} THEN 1 ELSE LIST_SUM(LIST_TRANSFORM(RANGE(0, CAST(k AS BIGINT) + 1), lambda i:
  EXP(LGAMMA(n + 1) - LGAMMA(i + 1) - LGAMMA(n - i + 1) + i * LN({_P}) + (n - i) * LN(1 - {_P})))) END AS tail FROM k),
 h AS (SELECT stratum, rule, COALESCE(CAST(k0 AS DOUBLE) / NULLIF(n0, 0), 0) - 10 * CAST(k AS DOUBLE) / n AS gain, cutoff FROM s WHERE tail * tests <= {quality.DELTA} AND k0 > 0),
 best AS (SELECT stratum, rule, cutoff FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) AS rn FROM h) z WHERE rn = 1 AND gain > 0),
 bad AS (SELECT DISTINCT x.doc_id FROM x JOIN best ON x.stratum = best.stratum AND x.rule = best.rule WHERE ratio > cutoff)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad ON f.doc_id = bad.doc_id"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, ARRAY_TO_STRING(w[k:k + 3], ' ') AS g FROM (
  SELECT doc_id, w, UNNEST(RANGE(1, GREATEST(LEN(w) - 3, 1) + 1)) AS k FROM w WHERE LEN(w) > 0) x),
 n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT x, y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
 reach(doc, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc, e.y FROM reach JOIN e ON reach.other = e.x),
 c AS (SELECT doc, MIN(other) AS component_id FROM reach GROUP BY doc)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.doc = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

FILL_IN_MIDDLE = r"""
WITH u AS (SELECT doc_id, COALESCE(text, '') AS t, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS units,
  SHA256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
 d AS (SELECT doc_id, t, units, LEN(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (LEN(units) + 1) AS c1,
  CAST('0x' || h[9:16] AS BIGINT) % (LEN(units) + 1) AS c2, CASE WHEN h IS NULL OR t = '' OR CONTAINS(t, '<P>')
   OR CONTAINS(t, '<S>') OR CONTAINS(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
   WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT doc_id, t, n, form, ARRAY_TO_STRING(units[1:LEAST(c1, c2)], '') AS pre,
  ARRAY_TO_STRING(units[LEAST(c1, c2) + 1:GREATEST(c1, c2)], '') AS mid,
  ARRAY_TO_STRING(units[GREATEST(c1, c2) + 1:n], '') AS suf FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(LENGTH(pre) AS BIGINT) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN CAST(LENGTH(mid) AS BIGINT) END AS middle_chars,
 SHA256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
  WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, SHA256(t) AS restored_sha256
FROM p"""
