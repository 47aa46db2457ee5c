"""SQL of the operators on terms, for the reference database."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
terms AS (
  SELECT id, lang, source,
    unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY lang, term
  HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
sources AS (
  SELECT d.lang, d.source, coalesce(l.v, 0) AS v, coalesce(l.lang_total, 0) AS lang_total,
    coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + s.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (s.lang_total + s.v)::HUGEINT AS q
  FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200
"""

SEARCH = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all({_LOWER.format('text')},
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT *, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sized),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format('text')},
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
found AS (
  SELECT id, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT id, doc_id, n, unnest(terms) AS term FROM sized)
  SEMI JOIN wanted USING (term) GROUP BY id, doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM found, corpus GROUP BY term),
scores AS (
  SELECT item_id, id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms)))) AS score
  FROM found JOIN weights USING (term) JOIN wanted USING (term), corpus
  GROUP BY item_id, id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, id) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score::BIGINT AS score FROM ranked WHERE rank <= 10
"""
