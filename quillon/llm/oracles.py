"""SQL for operators whose results it can express, though only on small tables: all windows, all pairs.

The embeddings' SQL is exact; op9 matches it where its recall is complete, as on the driver's tables.
"""

OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN ['#' || array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT reach.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""
OP9_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.r = link.a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT c.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON k.vec_id = c.vec_id
"""
OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS p FROM t WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN least USING (h) WHERE d < doc_id) GROUP BY doc_id),
words AS (SELECT doc_id, w[i + 1] AS x, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM t)),
lost AS (SELECT doc_id, unnest(g) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
