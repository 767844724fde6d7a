"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

# Fixed values of the contract: what is lower-cased, and what a word is.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) t(i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
 e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
 reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, e.v FROM reach JOIN e ON e.u = reach.other),
 c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
 SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
 FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

DECONTAMINATION = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 i AS (SELECT item_id, ws, least(5, len(ws)) AS k FROM (SELECT item_id, {WORDS} AS ws FROM benchmark) b WHERE len(ws) > 0),
 q AS (SELECT DISTINCT item_id, k, array_to_string(ws[j:j + k - 1], ' ') AS shingle FROM i, unnest(range(1, len(ws) - k + 2)) t(j)),
 n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY 1),
 d AS (SELECT DISTINCT doc_id, k, array_to_string(ws[j:j + k - 1], ' ') AS shingle FROM w, (SELECT DISTINCT k FROM i) ks, unnest(range(1, len(ws) - k + 2)) t(j)),
 m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN q USING (k, shingle) GROUP BY 1, 2)
 SELECT doc_id, item_id, shared, n_item, shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE 100 * shared >= 80 * n_item"""

EXACT_SEARCH = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 tf AS (SELECT doc_id, word, count(*) AS f FROM (SELECT doc_id, unnest(ws) AS word FROM w) u GROUP BY 1, 2),
 df AS (SELECT word, count(*) AS n FROM tf GROUP BY 1),
 total AS (SELECT count(*) AS docs, sum(len(ws)) / count(*) AS average FROM w),
 hits AS (SELECT q.doc_id AS query_id, t.doc_id, fsum(ln(1 + (docs - n + 0.5) / (n + 0.5)) * t.f * 2.2 / (t.f + 1.2 * (0.25 + 0.75 * len(w.ws) / average))) AS score
  FROM tf q JOIN df USING (word) JOIN tf t USING (word) JOIN w ON w.doc_id = t.doc_id, total WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hits)
 SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10"""


def _rounds(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """Centroids and assignments of every round, each measured against all."""
    steps = [f"""x AS (SELECT vec_id, list_transform(embedding, lambda e: floor({width} * e::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
 c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM x ORDER BY c LIMIT {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, any_value(x.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.c)) AS best
 FROM x, c{t} c GROUP BY 1)""")
        if t < rounds:
            steps.append(f"""s{t} AS (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, unnest(range(1, {width + 1})) u(i) GROUP BY 1, 2),
 c{t + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN
 (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{t} GROUP BY 1) m ON m.c = c.c)""")
    return ",\n ".join(steps)


CENTROID_CLUSTERS = f"""WITH {_rounds()}
 SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
 (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 c ON c.c = best.c"""

SOURCE_MIX = r"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
 md5('1:' || coalesce(source, '') || ':' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS n, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY 1),
 fill(step, source, n, w, stops, level) AS (
  SELECT 0, source, n, w, false, sum(n) OVER () / sum(w) OVER () FROM s
  UNION ALL
  SELECT step + 1, source, n, w, now, CASE WHEN sum(w) FILTER (NOT now) OVER () > 0 THEN
   ((sum(n) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * n) FILTER (now) OVER (), 0)) / sum(w) FILTER (NOT now) OVER () ELSE 0 END
  FROM (SELECT *, stops OR level * w >= 3.0 * n AS now FROM fill) WHERE step < 30),
 t AS (SELECT source, n, CASE WHEN stops THEN 3.0::DOUBLE * n ELSE level * w END AS target FROM fill WHERE step = 30),
 b AS (SELECT *, CASE WHEN n > 0 THEN least(round(target)::BIGINT // n, 3) ELSE 0 END AS times FROM t),
 o AS (SELECT d.*, n, target, times, round(target)::BIGINT - times * n AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source)
 SELECT doc_id, size::BIGINT AS size, n AS source_size, target, (times * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o"""

HARD_NEGATIVES = """WITH x AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
 p AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM x a, x b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score FROM pos JOIN p USING (anchor_id)
 WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
 QUALIFY rank <= 10"""
