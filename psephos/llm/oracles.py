"""DuckDB SQL for the queries of this package that SQL can express."""
from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op9_exact_index"] = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

ORACLES["op12_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), smallest AS (
  SELECT text, min(doc_id) AS first FROM words GROUP BY text
), flags AS (
  SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INT
         + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > first, false)::INT AS fails
  FROM words JOIN smallest USING (text) LEFT JOIN flags ON doc_id = id
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(f), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(f),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(f), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(f),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(f)
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS filter,
         1 << instr('ABCDE', substr(filter_order, step::INT, 1))::INT - 1 AS bit,
         list_sum([1 << instr('ABCDE', x)::INT - 1 FOR x IN string_split(substr(filter_order, 1, step::INT - 1), '') IF x <> ''])::INT AS before
  FROM orders, range(1, 6) t(step)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, filter,
         sum(n) FILTER (fails & (coalesce(before, 0) | bit) = 0) AS kept,
         sum(n) FILTER (fails & bit <> 0 AND fails & coalesce(before, 0) = 0) AS removed,
         sum(n) FILTER (fails & bit <> 0 AND fails & coalesce(before, 0) <> 0) AS redundant,
         sum(n) FILTER (fails = bit) AS unique_fails,
         sum(good) FILTER (fails & bit <> 0 AND fails & coalesce(before, 0) = 0) AS good_lost,
         sum(toxic) FILTER (fails & bit <> 0 AND fails & coalesce(before, 0) = 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM counted
"""

ORACLES["op13_treap_search"] = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), sizes AS (
  SELECT row_number() OVER () AS row, doc_id, t, len(t)::BIGINT AS n FROM terms WHERE len(t) > 0
), totals AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes
), postings AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row, doc_id, n, unnest(t) AS term FROM sizes) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term, docs
), wanted AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
), scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term), totals
  GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
