"""What DuckDB must find for the queries that SQL can express on whole tables."""

from __future__ import annotations

#: Words of a text t, as a list.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
 sh AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))) END AS s FROM w),
 cls AS MATERIALIZED (SELECT s, min(doc_id) AS rep FROM sh WHERE len(s) > 0 GROUP BY s),
 ex AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS g FROM cls),
 e AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM ex a JOIN ex b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach(node, label) AS (SELECT rep, rep FROM cls UNION SELECT ways.b, reach.label FROM reach JOIN ways ON ways.a = reach.node),
 least AS MATERIALIZED (SELECT node, min(label) AS label FROM reach GROUP BY node)
 SELECT doc_id, len(sh.s) AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(rep, doc_id) AS class_id FROM sh LEFT JOIN cls ON cls.s = sh.s AND len(sh.s) > 0 LEFT JOIN least ON node = rep"""

_RATES = {"symbols": ("n_symbols", 0.1), "dup_lines": ("n_dup_lines", 0.1), "word_length": ("word_chars", 3.0)}
_EACH = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, CAST(floor(ln({c} / n_words + 1 / 256) / ln(17 / 16)) AS BIGINT) AS bucket FROM m WHERE NOT base_failed" for m, (c, _) in _RATES.items())
_FENCES = ", ".join(f"max(CASE WHEN measure = '{m}' THEN q1 - 3 * (q3 - q1) - {x} END) AS least_{m}, max(CASE WHEN measure = '{m}' THEN q3 + 3 * (q3 - q1) + {x} END) AS most_{m}" for m, (_, x) in _RATES.items())
_INSIDE = " AND ".join(f"coalesce({c} / greatest(n_words, 1) BETWEEN least_{m} AND most_{m}, TRUE)" for m, (c, _) in _RATES.items())

QUALITY_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 p AS MATERIALIZED (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8),
 q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(ws, i, i + 7), ' ')) AS c FROM p),
 r AS MATERIALIZED (SELECT doc_id, count(DISTINCT i + k) AS n FROM q, range(8) x(k) WHERE c > 1 GROUP BY doc_id),
 l AS MATERIALIZED (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 m0 AS (SELECT d.doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
 m AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0),
 s AS MATERIALIZED (SELECT lang, source, measure, bucket, count(*) AS n FROM ({_EACH}) GROUP BY ALL),
 lv AS (SELECT 0 AS lvl, lang, source, measure, bucket, n FROM s UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM s GROUP BY lang, measure, bucket UNION ALL SELECT 2, NULL, NULL, measure, bucket, sum(n) FROM s GROUP BY measure, bucket),
 u AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, measure) AS total FROM lv),
 qn AS MATERIALIZED (SELECT lvl, lang, source, measure, any_value(total) AS total, min(pow(17 / 16, bucket + 0.5) - 1 / 256) FILTER (upto >= 0.25 * total) AS q1, min(pow(17 / 16, bucket + 0.5) - 1 / 256) FILTER (upto >= 0.75 * total) AS q3 FROM u GROUP BY lvl, lang, source, measure),
 g AS (SELECT DISTINCT lang, source, measure FROM s),
 f AS (SELECT g.lang, g.source, g.measure, CASE WHEN a.total >= 200 THEN a.q1 WHEN b.total >= 200 THEN b.q1 ELSE c.q1 END AS q1, CASE WHEN a.total >= 200 THEN a.q3 WHEN b.total >= 200 THEN b.q3 ELSE c.q3 END AS q3 FROM g
  JOIN qn a ON a.lvl = 0 AND a.measure = g.measure AND a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source JOIN qn b ON b.lvl = 1 AND b.measure = g.measure AND b.lang IS NOT DISTINCT FROM g.lang JOIN qn c ON c.lvl = 2 AND c.measure = g.measure),
 lim AS (SELECT lang, source, {_FENCES} FROM f GROUP BY lang, source)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_INSIDE} AS kept FROM m LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM m.lang AND lim.source IS NOT DISTINCT FROM m.source"""
