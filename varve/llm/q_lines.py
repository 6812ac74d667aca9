"""Query of line dedup."""

from __future__ import annotations

from .common import table
from .line_dedup import BY_LENGTH, duplicate_lines


def op10(spark, sf_dir):
    return duplicate_lines(table(spark, sf_dir, "documents"))


def op10_by_length(spark, sf_dir):
    return duplicate_lines(table(spark, sf_dir, "documents"), BY_LENGTH)


QUERIES = {"op10_line_dedup": op10, "op10_line_dedup_by_length": op10_by_length}
SQL = {"op10_line_dedup": """
WITH RECURSIVE l AS (
  SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS line_no, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), lines AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, min((doc_id, line_no)) AS first FROM lines GROUP BY line),
links AS (
  SELECT a.line AS a, b.line AS b FROM (SELECT line FROM d WHERE length(line) >= 20) a JOIN (SELECT line FROM d WHERE length(line) >= 20) b
  ON length(b.line) BETWEEN length(a.line) - 1 AND length(a.line) + 1 AND a.line <> b.line
  WHERE (left(a.line, length(a.line) // 2 - 1) = left(b.line, length(a.line) // 2 - 1) OR right(a.line, length(a.line) // 2 - 1) = right(b.line, length(a.line) // 2 - 1))
    AND levenshtein(a.line, b.line) <= 1
), reach(line, spot) AS (
  SELECT a, a FROM links UNION SELECT r.line, k.b FROM reach r JOIN links k ON r.spot = k.a
), c AS (
  SELECT r.line, min(d.first) AS class FROM reach r JOIN d ON d.line = r.spot GROUP BY r.line
), n AS (SELECT a AS line, count(*) AS links FROM links GROUP BY a)
SELECT s.doc_id, s.line_no, coalesce(c.class, d.first)[1] AS class_doc_id, coalesce(c.class, d.first)[2] AS class_line_no,
  coalesce(n.links, 0) AS links, coalesce(c.class, d.first) = (s.doc_id, s.line_no) AS kept
FROM lines s JOIN d ON d.line = s.line LEFT JOIN c ON c.line = s.line LEFT JOIN n ON n.line = s.line
""",
    # k edits leave one of k + 1 segments whole; levenshtein counts bytes, so each pair's other characters become free ASCII ones
    "op10_line_dedup_by_length": """
WITH RECURSIVE l AS (
  SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS line_no, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), lines AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, min((doc_id, line_no)) AS first FROM lines GROUP BY line),
s AS MATERIALIZED (SELECT line, length(line) AS n, length(line) // 4 AS m, least(3, length(line) // 20) AS k FROM d WHERE length(line) >= 20),
pairs AS MATERIALIZED (
  SELECT a.line AS a, b.line AS b, a.k, a.line || b.line AS ab FROM s a JOIN s b
  ON b.n BETWEEN a.n AND a.n + 3 AND (a.n < b.n OR a.line < b.line)
  WHERE b.n <= a.n + a.k AND (contains(b.line, left(a.line, a.m)) OR contains(b.line, substring(a.line, a.m + 1, a.m))
    OR contains(b.line, substring(a.line, 2 * a.m + 1, a.m)) OR contains(b.line, substring(a.line, 3 * a.m + 1)))
), spelt AS (
  SELECT a, b, k, array_to_string(list_distinct(string_split(regexp_replace(ab, '[\x01-\x7F]', '', 'g'), '')), '') AS other,
    array_to_string([chr(CAST(i AS INTEGER)) FOR i IN range(1, 128) IF NOT contains(ab, chr(CAST(i AS INTEGER)))], '') AS free
  FROM pairs
), near AS MATERIALIZED (SELECT a, b FROM spelt WHERE levenshtein(translate(a, other, free), translate(b, other, free)) <= k),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(line, spot) AS (
  SELECT a, a FROM links UNION SELECT r.line, k.b FROM reach r JOIN links k ON r.spot = k.a
), c AS (
  SELECT r.line, min(d.first) AS class FROM reach r JOIN d ON d.line = r.spot GROUP BY r.line
), n AS (SELECT a AS line, count(*) AS links FROM links GROUP BY a)
SELECT s.doc_id, s.line_no, coalesce(c.class, d.first)[1] AS class_doc_id, coalesce(c.class, d.first)[2] AS class_line_no,
  coalesce(n.links, 0) AS links, coalesce(c.class, d.first) = (s.doc_id, s.line_no) AS kept
FROM lines s JOIN d ON d.line = s.line LEFT JOIN c ON c.line = s.line LEFT JOIN n ON n.line = s.line
""",
}
