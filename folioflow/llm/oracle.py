"""DuckDB SQL of the operators whose whole result SQL can express."""

from __future__ import annotations

#: Links (u, v) in both directions over nodes (id): the smallest id that each reaches.
_REACH = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.v AS b FROM reach r JOIN e ON r.b = e.u),
top AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM met WHERE 100 * c >= 90 * (nu + nv - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN top ON top.id = s.doc_id"""

NEAR_EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM e WHERE e.u = top.id) AS n_links, component_id, id = component_id AS kept FROM top"""

COLLOCATIONS = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) x(m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n::HUGEINT) // (l.a::HUGEINT * r.a) AS score FROM c JOIN t ON t.lang = c.lang
 JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(ws, 1, c.k), ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(ws, c.k + 1, c.m), ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s),
i AS (SELECT lang, a, unnest(list_transform(range(1, m - z + 2), lambda j: array_to_string(list_slice(string_split(phrase, ' '), j, j + z - 1), ' '))) AS phrase FROM f, (VALUES (2), (3), (4)) y(z) WHERE z < m),
h AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.n, b.score FROM b LEFT JOIN h USING (lang, phrase) WHERE place = 1 AND (longer IS NULL OR longer < b.a)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM k WHERE rank <= 2000"""
