"""DuckDB SQL of the operators that SQL can express."""

HARD_NEGATIVES = """
WITH good AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.rid <> b.rid
), positives AS (
  SELECT rid, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST, n.other))::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.rid = p.rid AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

PREFIX_TRIE = """
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), crc(c, s, bit, v) AS (
  SELECT DISTINCT c, c::VARCHAR, 0, 4294967295::BIGINT FROM turns
  UNION ALL
  SELECT c, s, bit + 1, xor(w >> 1, CASE WHEN w & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT c, s, bit, CASE WHEN bit % 8 = 0 THEN xor(v, ascii(s[bit // 8 + 1])::BIGINT) ELSE v END AS w FROM crc WHERE bit < 8 * length(s))
), convs AS (
  SELECT c, c - c % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE bit = 8 * length(s)
), rebuilt AS (
  SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN turns ON turns.c = base AND pos < h
  UNION ALL
  SELECT convs.c, 1, pos, role, text FROM convs JOIN turns ON turns.c = convs.c AND pos >= h
), paths AS (
  SELECT c, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS path FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
), members AS (
  SELECT c, len(path) AS n_turns, unnest(range(0, len(path) + 1)) AS depth, path FROM paths
), nodes AS (
  SELECT depth, list_slice(path, 1, depth) AS prefix, list_slice(path, 1, greatest(depth - 1, 0)) AS above, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n_turns = depth), '') AS ends
  FROM members GROUP BY ALL
), kids AS (
  SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), weighed AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth].text) END AS saved
  FROM nodes LEFT JOIN kids USING (depth, prefix)
), up AS (
  SELECT unnest(range(0, depth + 1)) AS d, prefix, n_children, saved FROM weighed
), sums AS (
  SELECT d AS depth, list_slice(prefix, 1, d) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM weighed n JOIN sums s USING (depth, prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.above
"""

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(d, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT d, b FROM reach JOIN links ON a = r
)
SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes ON doc_id = d GROUP BY d
"""
