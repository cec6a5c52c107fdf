"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from ratingloom.llm import hosts

WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES = {
    "op1_host_quality": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, {WORDS}) AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORDS})) AS lines
  FROM d
), win AS (
  SELECT rid, unnest(range(1, len(words) - 3)) AS i,
         unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS five
  FROM w WHERE len(words) >= 5
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(*) AS n FROM
    (SELECT DISTINCT rid, i + k AS at FROM twice, (SELECT unnest(range(0, 5)) AS k)) GROUP BY rid
), s AS (
  SELECT w.rid, doc_id, source, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f
  FROM b WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT count(*) AS k, sum(n) AS nn, sum(f) AS ff, sum(f * f / n) AS fq, sum(n * n) AS nq FROM h
), r AS (
  SELECT ff / nn AS mean,
         ((fq - ff * ff / nn) / nullif(ff / nn * (1 - ff / nn), 0) - (k - 1))
           / nullif(nn - nq / nn - (k - 1), 0) AS rho FROM m
), v AS (
  SELECT source, (f + g * mean) / (n + g) > {hosts.MAX_RATE} AS rejected
  FROM h, (SELECT mean, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, {hosts.PRIOR_LEAST}),
           {hosts.PRIOR_MOST}) ELSE {hosts.PRIOR_MOST} END AS g FROM r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(rejected, false) AS host_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN v USING (source)
""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), z AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION SELECT node, link.b FROM reach JOIN link ON other = link.a
), c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id,
       vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id
""",
    "op8_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
         WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
         END) AS shingles FROM w
), u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT node, link.b FROM reach JOIN link ON other = link.a
)
SELECT s.doc_id, len(shingles) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) ON s.doc_id = node
""",
    "op5_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, (sum(source_size) OVER need - source_size)::BIGINT AS before,
         (sum(weight) OVER () - sum(weight) OVER need + weight)::BIGINT AS weight_left,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM s WINDOW need AS (ORDER BY source_size / weight, weight ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT *, (total - 3 * before)::DOUBLE / weight_left AS level FROM o
), p AS (
  SELECT source, source_size,
         least(weight * (SELECT arg_min(level, before) FROM l WHERE 3 * source_size > weight * level),
               (3 * source_size)::DOUBLE) AS target FROM l
), q AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS copies FROM p
), g AS (
  SELECT d.*, source_size, target, copies, target - copies * source_size AS rest,
         (sum(size) OVER (PARTITION BY d.source ORDER BY h))::BIGINT AS through,
         (sum(size) OVER (PARTITION BY d.source, h))::BIGINT AS own
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       size * (copies + (rest > 0 AND (through <= rest
         OR rest > through - own AND through - rest < rest - (through - own)))::BIGINT) AS taken
FROM g
""",
    "op13_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER place::INT AS rank, other AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW place AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY rank <= 3
""",
}
