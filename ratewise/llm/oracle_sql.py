"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

from ratewise.llm import divergence, line_dedup, preference

#: Op 6: shingle sets as lists, links by counting common shingles, components by following links.
NEAR_DEDUP = """
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1),
    lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM worded),
classes AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, len(s) AS n, unnest(s) AS item FROM classes),
linked AS (
  SELECT a.rep AS u, b.rep AS v FROM items a JOIN items b ON a.item = b.item AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
steps AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked),
reach(node, root) AS (
  SELECT rep, rep FROM classes UNION SELECT steps.v, reach.root FROM reach JOIN steps ON steps.u = reach.node),
named AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, sets.doc_id) AS component_id,
  sets.doc_id = coalesce(component, sets.doc_id) AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN named ON node = rep
"""

#: Op 8: first occurrences of the lines, and the lines near an earlier one among those of like length.
LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
firsts AS (
  SELECT line, min(row(doc_id, pos)) AS at, length(line) AS n FROM lines
  WHERE trim(line) <> '' GROUP BY line),
late AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b
    ON b.n IN ({", ".join(f"a.n + {k}" for k in range(-line_dedup.MAX_EDITS, line_dedup.MAX_EDITS + 1))})
  WHERE a.n >= {line_dedup.MIN_CHARS} AND b.n >= {line_dedup.MIN_CHARS} AND a.at < b.at AND levenshtein(a.line, b.line) <= {line_dedup.MAX_EDITS}),
judged AS (
  SELECT l.doc_id, l.pos, l.line, f.at IS NULL OR f.at = row(l.doc_id, l.pos) AND late.line IS NULL AS keep
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN late ON late.line = l.line)
SELECT d.doc_id, count(pos)::INTEGER AS n_lines, count(pos) FILTER (keep)::INTEGER AS n_kept,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '') END AS text
FROM documents d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id
"""

ORACLE_SQL = {
    "op3_preference_formatting": preference.ORACLE,
    "op6_minhash_near_dedup": NEAR_DEDUP,
    "op8_line_dedup": LINE_DEDUP,
    "op13_source_divergence": divergence.ORACLE,
}
