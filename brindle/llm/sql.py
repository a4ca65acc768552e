"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '{_WORD}')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, w[i + 1 : i + least(len(w), 10)] AS g
        FROM (SELECT item, w, unnest(generate_series(0, greatest(len(w), 10) - 10)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, w[i + 1 : i + n] AS g
       FROM (SELECT r, w, n, unnest(generate_series(0, len(w) - n)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, win.item FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in ("</s>", "[INST]", "[/INST]"):
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_TOKENS = rf"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\x20\x09-\x0D]+')"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
      FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS o FROM n UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.o),
comp AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN comp USING (r)
"""

# CRC-32 of the ASCII digits of conv_id, bit by bit.
_CRC = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST({0} AS VARCHAR), '')]), lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(i AS BIGINT) FOR i IN range(8)]), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))"

PREFIX_TRIE = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS own, xor({_CRC.format("c")}, 4294967295) % 6 AS h FROM t GROUP BY c),
reb AS (SELECT o.c, list_concat(coalesce(b.own, [])[1 : o.h], o.own[o.h + 1 :]) AS w FROM o LEFT JOIN o b ON b.c = o.c - o.c % 100),
p AS (SELECT c, len(w) AS n, d, w[1 : d] AS k FROM (SELECT c, w, unnest(generate_series(0, len(w))) AS d FROM reb)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, CASE WHEN d = 0 THEN 0 ELSE length(k[d].t) END AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY k, d),
sub AS (SELECT k[1 : e] AS k, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE d = e + 1) AS n_children
        FROM (SELECT k, d, leaf, n_convs, chars, unnest(generate_series(0, d)) AS e FROM node) GROUP BY k[1 : e])
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, CAST(sub.n_children AS BIGINT) AS n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN sub ON sub.k = node.k LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.k = node.k[1 : node.d - 1]
"""

HARD_NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.id AS anchor_id, b.id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.r != b.r WHERE a.id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS n FROM s WHERE alike) WHERE n <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score) WHERE rank <= 3
"""

# Bytes as pairs of hexadecimal digits; d numbers the different documents in order.
SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER (ORDER BY o, text) AS r, o, text, hex(encode(text)) AS b FROM (SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS o, coalesce(text, '') AS text FROM documents)),
k AS (SELECT r, 200 * k AS k, substr(b, CAST(400 * k + 1 AS BIGINT), 598) AS b FROM (SELECT r, b, unnest(generate_series(0, len(b) // 400)) AS k FROM d WHERE len(b) >= 200)),
w AS (SELECT r, k + q AS p, substr(b, CAST(2 * q + 1 AS BIGINT), 200) AS s FROM (SELECT r, k, b, unnest(generate_series(0, len(b) // 2 - 100)) AS q FROM k WHERE len(b) >= 200)),
f AS (SELECT md5(s) AS m, min(r * 4294967296 + p) AS first FROM w GROUP BY m HAVING count(*) > 1),
r AS (SELECT r, p FROM w JOIN f ON md5(s) = m WHERE r * 4294967296 + p > first),
g AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
z AS (SELECT r, min(p) AS a, max(p) + 100 AS e FROM g GROUP BY r, run),
c AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substr(b, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept, max(e) AS e
      FROM (SELECT r, b, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM z JOIN d USING (r)) GROUP BY r)
SELECT q.doc_id, CAST(len(d.b) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.r IS NULL THEN d.b ELSE coalesce(c.kept, '') || substr(d.b, CAST(2 * c.e + 1 AS BIGINT)) END)) AS kept_sha256
FROM documents q JOIN d ON coalesce(q.doc_id, 9223372036854775807) = d.o AND coalesce(q.text, '') = d.text LEFT JOIN c ON c.r = d.r
"""
