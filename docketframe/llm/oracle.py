"""The queries that SQL can express, restated for DuckDB."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

# Targets: with the k sources of the smallest size per weight stopped at three times their size, the rest share what is left.
MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM sources
), levels AS (
  SELECT a.k, CAST((SELECT sum(source_size) FROM sources) - coalesce((SELECT sum(3 * source_size) FROM ranked b WHERE b.k < a.k), 0) AS DOUBLE)
              / (SELECT sum(weight) FROM ranked b WHERE b.k >= a.k) AS level, 3 * source_size AS full_size, weight
  FROM ranked a
), chosen AS (
  SELECT coalesce((SELECT level FROM levels WHERE full_size > level * weight ORDER BY k LIMIT 1), 0) AS level
), targets AS (
  SELECT source, source_size, CASE WHEN 3 * source_size <= level * weight OR level = 0 THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target
  FROM sources, chosen
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('17:' || CAST(d.doc_id AS VARCHAR)), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS drawn
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""

LINKED = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {{size}} THEN [array_to_string(w[i:i + {{size}} - 1], ' ') FOR i IN range(1, len(w) - {{size}} + 2)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {{threshold}} * (x.n + y.n - k)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, p.component_id{{more}}
FROM documents d JOIN parts p USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

MINMAX = LINKED.format(size=4, threshold=80, more=", d.doc_id = p.component_id AS kept")
NGRAM_JOIN = LINKED.format(size=3, threshold=90, more="")

CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

PREFIX_TRIE = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 1 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 2, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list([role, text]) OVER w AS node, text FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, [], '' FROM convs
), nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * len(regexp_extract_all(any_value(text), '{WORDS}')) AS saved
  FROM paths GROUP BY node
), below AS (SELECT DISTINCT a.node AS top, b.node AS node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), children AS (SELECT top, count(*) AS n FROM below JOIN nodes t ON t.node = top JOIN nodes n ON n.node = below.node WHERE n.depth = t.depth + 1 GROUP BY top
), totals AS (
  SELECT b.top, sum(n.saved) AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON n.node = b.node LEFT JOIN children c ON c.top = b.node GROUP BY b.top
), ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths) p
  WHERE depth = last GROUP BY node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN totals t ON t.top = n.node LEFT JOIN children c ON c.top = n.node LEFT JOIN ends e ON e.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[:n.depth - 1] AND p.depth = n.depth - 1
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, anchor_label, other_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10
"""

ORACLE_SQL = {"op2_exact_dedup": EXACT_DEDUP, "op3_mixing": MIXING, "op8_minmax": MINMAX, "op11_ngram_join": NGRAM_JOIN, "op12_prefix_trie": PREFIX_TRIE, "op13_hard_negatives": HARD_NEGATIVES}
