"""Query of mixing to target weights."""

from __future__ import annotations

from .common import table
from .mixing import mixture


def op5(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"))


def _share(name: str, nodes: str, parent: str, level: str) -> str:
    by = f"PARTITION BY {parent}"
    return f"""
{name}0 AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM ({nodes})),
{name}1 AS (SELECT *, row_number() OVER ({by} ORDER BY ratio, {level}) AS k,
    total - coalesce(sum(cap) OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
    sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rw FROM {name}0),
{name}2 AS (SELECT *, coalesce(min(CASE WHEN cap * rw > r * weight THEN k END) OVER ({by}), 1 << 30) AS first FROM {name}1),
{name}3 AS (SELECT *, max(CASE WHEN k = first THEN r END) OVER ({by}) AS pr, max(CASE WHEN k = first THEN rw END) OVER ({by}) AS pw FROM {name}2),
{name} AS (SELECT *, CASE WHEN k < first THEN cap ELSE weight * pr // pw END AS budget FROM {name}3)"""


QUERIES = {"op5_mixing_to_target_weights": op5}
SQL = {"op5_mixing_to_target_weights": f"""
WITH d AS (
  SELECT doc_id, 'domain' || CAST(coalesce(try_cast(nullif(regexp_extract(source, '([0-9])$', 1), '') AS INTEGER), 0) % 4 AS VARCHAR) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents
), s AS (SELECT domain, lang, source, CAST(sum(n) AS HUGEINT) AS tokens, CAST(2 * sum(n) AS HUGEINT) AS cap FROM d GROUP BY ALL),
t AS (SELECT least(CAST(floor(sum(tokens) * 0.8::DOUBLE) AS HUGEINT), sum(cap)) AS total FROM s),
{_share("a", "SELECT domain, sum(cap) AS cap, CAST(1 AS HUGEINT) AS weight, max(total) AS total FROM s, t GROUP BY domain", "1", "domain")},
{_share("b", "SELECT s.domain, lang, sum(s.cap) AS cap, CAST(CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS HUGEINT) AS weight, max(a.budget) AS total FROM s JOIN a ON a.domain = s.domain GROUP BY s.domain, lang", "domain", "lang")},
{_share("c", "SELECT s.domain, s.lang, source, s.cap, s.tokens, CAST(1 AS HUGEINT) AS weight, b.budget AS total FROM s JOIN b ON b.domain = s.domain AND b.lang = s.lang", "domain, lang", "source")},
p AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM c WHERE tokens > 0 AND budget > 0),
e AS (SELECT d.*, epochs, rest, md5('42:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS key FROM d JOIN p USING (domain, lang, source)),
f AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM e)
SELECT doc_id, domain, lang, source, CAST(n AS BIGINT) AS tokens, CAST(epochs + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM f WHERE epochs + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END > 0
"""}
