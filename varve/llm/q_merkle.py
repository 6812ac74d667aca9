"""Query of the Merkle audit."""

from __future__ import annotations

from .common import table
from .merkle import aged, audit


def op1(spark, sf_dir):
    """All pages against a replica that aged by rule: the data hold one copy."""
    pages = table(spark, sf_dir, "pages")
    return audit(pages, aged(pages))


QUERIES = {"op1_warc_merkle_audit": op1}
SQL = {"op1_warc_merkle_audit": """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, left(md5(CAST(page_id AS VARCHAR)), 3) AS draw FROM pages),
r AS (
  SELECT page_id, url, CASE WHEN draw < '00c' THEN left(html, length(html) // 2) || '¤' || substr(html, CAST(length(html) // 2 + 2 AS BIGINT)) ELSE html END AS html,
    unnest(CASE WHEN draw = 'c80' THEN [1, 2] ELSE [1] END) AS k FROM p WHERE draw <> '640'
), w AS (
  SELECT 0 AS side, page_id, url, html FROM p UNION ALL SELECT 1, page_id, url, html FROM r
), x AS (
  SELECT side, page_id, page_id >> 8 AS file, 'WARC/1.0' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || n
    || 'WARC-Target-URI: ' || url || n || 'Content-Type: text/html' || n || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || n || n || html || n || n AS record
  FROM w, (SELECT chr(13) || chr(10) AS n)
), y AS (SELECT side, page_id, file, sha256(record) AS digest, CAST(strlen(record) AS BIGINT) AS length FROM x),
z AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY side, file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS start,
    CAST(row_number() OVER (PARTITION BY side, file, page_id ORDER BY digest) AS INTEGER) AS copy FROM y
), a AS (SELECT * FROM z WHERE side = 0), b AS (SELECT * FROM z WHERE side = 1)
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.copy, b.copy) AS copy,
  CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'altered' WHEN a.start <> b.start THEN 'moved' ELSE 'intact' END AS status,
  a.start AS start, a.length AS length, a.digest AS sha256, b.start AS replica_start, b.length AS replica_length, b.digest AS replica_sha256
FROM a FULL JOIN b ON a.page_id = b.page_id AND a.copy = b.copy
"""}
