"""SQL that says what the registered jobs return."""

from __future__ import annotations

from lodestack.plans.queries import STEM_SQL, STOP_SQL, TOKENS_SQL

_WORDS = r"len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> ''))::BIGINT AS words"

#: One batch brings every document, the second run nothing.
JOB1 = rf"""
WITH v AS (SELECT coalesce(doc_id::VARCHAR, 'sha256:' || sha256(coalesce(text, ''))) AS chunk_id, coalesce(nullif(lang, ''), 'none') AS corpus, coalesce(nullif(source, ''), 'none') AS source, coalesce(text, '') AS body FROM documents),
 l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY sha256(concat_ws(chr(10), length(corpus)::VARCHAR, corpus, length(source)::VARCHAR, source, body)) DESC) = 1),
 c AS (SELECT chunk_id, corpus, source || '/' || chunk_id AS rel, body, {_WORDS} FROM l), {TOKENS_SQL}
SELECT chunk_id AS doc, term, tf, words, 1 AS sign, 0 AS batch, corpus FROM post JOIN c USING (chunk_id)
"""

JOB2 = rf"""
WITH b AS (SELECT doc_id AS chunk_id, coalesce(nullif(lang, ''), 'none') AS corpus, coalesce(nullif(source, ''), 'none') AS source, coalesce(text, '') AS body FROM documents WHERE doc_id IS NOT NULL),
 c AS (SELECT *, source || '/' || chunk_id AS rel, {_WORDS} FROM b), {TOKENS_SQL},
 q AS (SELECT item_id AS query_id, max(coalesce(text, '')) AS ask FROM benchmark WHERE item_id IS NOT NULL GROUP BY ALL),
 qw AS (SELECT *, list_filter(regexp_extract_all(lower(ask), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2 AND x NOT IN ({STOP_SQL})) AS ws FROM q),
 asked AS (SELECT DISTINCT query_id, {STEM_SQL} AS term FROM (SELECT query_id, unnest(ws) AS t FROM qw)),
 st AS (SELECT count(*) AS n, avg(words) AS a FROM c), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 lex AS (SELECT query_id, chunk_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / a))), 6) AS score FROM post JOIN asked USING (term) JOIN df USING (term) JOIN c USING (chunk_id), st GROUP BY ALL),
 pool AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 40),
 capped AS (SELECT pool.*, source, corpus, body FROM pool JOIN c ON id = chunk_id QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) <= 3),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place FROM capped QUALIFY place <= 10),
 f AS (SELECT best.*, trim(regexp_replace(body, '\s+', ' ', 'g')) AS flat, list_filter(ws, lambda w: contains(lower(body), w))[1] AS w FROM best JOIN qw USING (query_id))
SELECT query_id AS search_id, place, id AS doc_id, source, score, trim(substr(flat, greatest(0, coalesce(instr(lower(flat), w), 0) - 31) + 1, 120)) AS excerpt, corpus FROM f
"""
