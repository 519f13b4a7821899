"""DuckDB SQL that gives the same rows, for the queries that SQL can express."""

OP1 = """
WITH point AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM point q JOIN point p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP3 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
cut AS (
  SELECT item, w, len(w) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(n, 10) AS width, array_to_string(w[k:k + least(n, 10) - 1], ' ') AS words FROM cut),
widths AS (SELECT DISTINCT width FROM win),
place AS (
  SELECT doc_id, width, k, array_to_string(w[k:k + width - 1], ' ') AS words
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM doc, widths WHERE len(w) >= width)),
hit AS (SELECT doc_id, item, k, place.width FROM place JOIN win USING (width, words)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + width)) AS p FROM hit) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
gram AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) END AS g FROM doc),
flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM gram),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * i >= 90 * (na + nb - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM gram LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""

OP10 = """
WITH page AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages),
first AS (SELECT digest, min(page_id) AS first FROM page WHERE size >= 100 GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CAST(CASE WHEN first < page_id THEN first END AS BIGINT) AS refers_to
FROM page LEFT JOIN first USING (digest)
"""

OP11 = r"""
WITH turn AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda r, z: xor(r >> 1, (r & 1) * 3988292384)), CAST(4294967295 AS BIGINT))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turn)),
head AS (SELECT c.conv_id, i AS d, role, text FROM conv c JOIN turn t ON t.conv_id = c.base AND t.i <= c.h),
lead AS (SELECT conv_id, count(*) AS n FROM head GROUP BY conv_id),
own AS (
  SELECT c.conv_id, t.i - c.h + coalesce(l.n, 0) AS d, role, text
  FROM conv c JOIN turn t USING (conv_id) LEFT JOIN lead l USING (conv_id) WHERE t.i > c.h),
seq AS (SELECT * FROM head UNION ALL SELECT * FROM own),
prefix AS (
  SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    list(sha256(sha256(role) || sha256(text))) OVER (PARTITION BY conv_id ORDER BY d) AS k FROM seq
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM conv),
node AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words FROM prefix GROUP BY k),
child AS (SELECT k[:-2] AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
own_values AS (SELECT node.*, coalesce(n, 0) AS n_children, (n_convs - 1) * words AS saved FROM node LEFT JOIN child USING (k)),
total AS (
  SELECT p.k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM own_values v JOIN prefix p ON p.conv_id = v.conv_id AND p.d <= v.depth GROUP BY p.k),
last AS (SELECT conv_id, max(d) AS d FROM prefix GROUP BY conv_id),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last JOIN prefix USING (conv_id, d) GROUP BY k)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children,
  CAST(total.n_leaves AS BIGINT) AS n_leaves, CAST(total.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own_values v JOIN total USING (k) LEFT JOIN ends USING (k) LEFT JOIN node up ON v.depth > 0 AND up.k = v.k[:-2]
"""

OP12 = """
WITH point AS (
  SELECT row_number() OVER () AS row, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, p.row, p.vec_id, a.label = p.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM point a JOIN point p ON a.vec_id % 50 = 0 AND a.row <> p.row AND len(a.v) = len(p.v)),
positive AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE same QUALIFY place <= 5),
negative AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positive p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT * FROM negative WHERE rank <= 3
"""

OP13 = """
WITH RECURSIVE point AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings),
sound AS (
  SELECT row, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM point
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.row AS a, b.row AS b FROM sound a JOIN sound b ON a.row <> b.row AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
first AS (SELECT r.a AS row, min(p.vec_id) AS least FROM reach r JOIN point p ON p.row = r.b GROUP BY r.a),
links AS (SELECT a AS row, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  coalesce(vec_id <= least, TRUE) AS kept
FROM point LEFT JOIN first USING (row) LEFT JOIN links USING (row)
"""

ORACLE: dict[str, str] = {
    "op1_exact_top_k": OP1,
    "op3_decontamination": OP3,
    "op7_ngram_jaccard_join": OP7,
    "op10_warc": OP10,
    "op11_prefix_trie": OP11,
    "op12_hard_negatives": OP12,
    "op13_near_vectors": OP13,
}
