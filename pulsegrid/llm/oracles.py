"""DuckDB SQL for the corpus queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g2 AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g2),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g3, (SELECT unnest(range(0, 5)) AS k) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f),
h AS (SELECT source AS host, count(*)::DOUBLE AS n, unnest([1, 2, 3]) AS rule,
             unnest([sum(base_failed::INT), sum((n_symbols * 100 > n_words * 10)::INT), sum((n_dup_lines > 2)::INT)])::DOUBLE AS x
      FROM b WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT rule, sum(n) AS n, sum(x) AS x, sum(x * x / n) AS xx FROM h GROUP BY rule),
p AS (SELECT h.*, a.x / a.n AS am, a.xx / a.n - (a.x / a.n) * (a.x / a.n) AS av, a.n - h.n AS o, a.x - h.x AS ox, a.xx - h.x * h.x / h.n AS oxx FROM h JOIN a USING (rule)),
q AS (SELECT *, CASE WHEN av > 1e-12 THEN least(1e6, greatest(1.0, am * (1 - am) / av - 1)) ELSE 1e6 END AS k, CASE WHEN o > 0 THEN ox / o END AS m FROM p),
z AS (SELECT *, round((x + k * am) / (n + k), 6) AS rate, CASE WHEN o > 0 THEN greatest(0.0, oxx / o - m * m) END AS v FROM q),
j AS (SELECT host, max(CASE WHEN rule = 1 THEN rate END) AS host_rate,
             bool_or(rate > 0.5 OR coalesce(rate > 2 * m AND rate > m + greatest(0.1, 3 * sqrt(v + m * (1 - m) / n)), false)) AS rejected
      FROM z GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce(rejected, false)) AS kept, host_rate, coalesce(rejected, false) AS host_rejected
FROM b LEFT JOIN j ON source = host
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('9:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT source, source_size, 2 * source_size AS lim, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
             - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM k),
m AS (SELECT max(level) AS level FROM l),
t AS (SELECT source, source_size, least(lim::DOUBLE, weight * m.level) AS target FROM k, m),
c AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS cut,
         (sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN cut // source_size ELSE 0 END * size
        + greatest(0, least(size, cut - CASE WHEN source_size > 0 THEN cut // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM c
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
z AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (
  SELECT i, item_id, term, count(*)::BIGINT AS c
  FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, z GROUP BY term),
s AS (
  SELECT i, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), z GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""

OP13 = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, r, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r)::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""

ORACLES = {"op1_host_quality": OP1, "op9_mixed_sources": OP9, "op12_ranked_documents": OP12, "op13_hard_negatives": OP13}
