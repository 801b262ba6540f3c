"""DuckDB SQL for the queries that SQL can express over whole tables.

The models (1, 5), the tokenizer (2), the markup rules (4) are not expressible; they are tested against brute force.
"""

from __future__ import annotations

from .license_scan import PHRASES, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _repeats(window: int, removed: str) -> str:
    """Words in windows that also start elsewhere."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS ws FROM documents),
 s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {window - 1}, 0) + 1)) AS i FROM d),
 k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS h FROM s),
 r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM k JOIN r USING (h)),
 w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
 x AS (SELECT doc_id, word, p, c.p IS NULL AS kept FROM w LEFT JOIN c USING (doc_id, p)),
 a AS (SELECT doc_id, count(*) FILTER (WHERE NOT kept) AS gone, string_agg(word, ' ' ORDER BY p) FILTER (kept) AS t FROM x GROUP BY doc_id)
 SELECT d.doc_id, len(ws) AS n_words, coalesce(gone, 0) AS {removed}, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""


_CLOSURE = """b AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach(x, y) AS (SELECT a, b FROM b UNION SELECT reach.x, b.b FROM reach JOIN b ON reach.y = b.a),
 comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)"""

_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACE}) AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
 {_CLOSURE}
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON x = d.doc_id"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND list_bool_and(list_transform(embedding, lambda z: z IS NOT NULL AND isfinite(z))) AND list_bool_or(list_transform(embedding, lambda z: z <> 0)) AS ok FROM embeddings),
 u AS (SELECT * FROM v WHERE ok),
 p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
 links AS (SELECT * FROM p), {_CLOSURE},
 k AS (SELECT a, count(*) AS n FROM b GROUP BY 1)
 SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
 FROM v LEFT JOIN k ON a = vec_id LEFT JOIN comp ON x = vec_id"""

_LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
 t AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark WHERE item_id IS NOT NULL),
 i AS (SELECT item_id, least(len(ws), 8) AS n, unnest(list_transform(range(1, greatest(len(ws) - 7, 1) + 1), lambda i: array_to_string(ws[i:i + 7], ' '))) AS win FROM t WHERE len(ws) > 0),
 z AS (SELECT DISTINCT n FROM i),
 s AS (SELECT doc_id, z.n, ws, unnest(range(1, greatest(len(ws) - z.n + 1, 0) + 1)) AS p FROM d, z),
 h AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS win FROM s) q JOIN i USING (n, win)),
 w AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
 m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
 SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN w USING (doc_id) LEFT JOIN m USING (doc_id)"""

_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
_SETS = ", ".join(f"({k}, '{label}', {2 * len(t.split())}, [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for k, (label, t) in enumerate(TEMPLATES))
_LICENSES = f"""WITH d AS (SELECT doc_id, text, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
 ph(phrase, label, n) AS (VALUES {_PHRASES}), tm(k, label, width, ts) AS (VALUES {_SETS}),
 s AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
 b AS (SELECT doc_id, p - 1 AS p, label FROM s JOIN ph ON ws[p] = split_part(phrase, ' ', 1) AND array_to_string(ws[p:p + n - 1], ' ') = phrase),
 e AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
 l AS (SELECT doc_id, ws, label, width, ts FROM d, tm WHERE len(list_intersect(ws, ts)) >= ceil(0.9::DOUBLE * len(ts) - 1e-9)),
 q AS (SELECT doc_id, label, width, ts, ws, unnest(range(1, len(ws) + 1)) AS p FROM l),
 o AS (SELECT doc_id, label, len(list_intersect(ws[p:p + width - 1], ts)) AS i, len(ts) AS m FROM q WHERE list_contains(ts, ws[p])),
 f AS (SELECT doc_id, label, i * 1.0::DOUBLE / m AS c FROM o WHERE i >= ceil(0.9::DOUBLE * m - 1e-9)),
 g AS (SELECT doc_id, max(c) AS score FROM f GROUP BY 1),
 a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM f) GROUP BY 1)
 SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
 coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
 FROM d LEFT JOIN e USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id)"""

SQL: dict[str, str] = {
    "op3_benchmark_decontamination": _LEAKS,
    "op6_embedding_near_dedup": _VECTORS,
    "op7_substring_dedup": _repeats(35, "n_removed"),
    "op8_suffix_array_dedup": _repeats(50, "n_repeated"),
    "op9_ngram_jaccard_join": _NEAR,
    "op10_license_scan": _LICENSES,
}
