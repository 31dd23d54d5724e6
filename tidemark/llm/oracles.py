"""DuckDB SQL for the rows of those operators that SQL can express."""

from __future__ import annotations

from itertools import permutations

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

FILTER_AUDIT = rf"""
WITH words AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS body, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT body, MIN(doc_id) AS least FROM words GROUP BY body
), marks AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM words JOIN firsts USING (body) LEFT JOIN marks USING (doc_id)
), cells AS (SELECT part, fails, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM failing GROUP BY part, fails
), orders(filter_order) AS (VALUES {_ORDERS}
), steps AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS f, filter_order[1:i - 1] AS earlier FROM orders, range(1, 6) AS r(i)
), counted AS (
  SELECT part, filter_order, step, f,
    SUM(CASE WHEN gone OR hit THEN 0 ELSE n END) AS kept, SUM(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    SUM(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, SUM(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    SUM(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, SUM(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(fails, f) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM cells, steps) GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

LEXICAL_SEARCH = r"""
WITH asked AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sized AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0
), totals AS (SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(SUM(n) AS BIGINT) AS tokens FROM sized
), postings AS (SELECT doc_id, term, CAST(COUNT(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, COUNT(*) AS df FROM postings GROUP BY term), totals
), scored AS (
  SELECT item_id, doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * total) // tokens))))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sized USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
