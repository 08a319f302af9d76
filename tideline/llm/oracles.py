"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
win AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS g FROM p),
g AS (SELECT doc_id, pos, sha256(array_to_string(g, ' ')) AS g FROM win WHERE len(g) = 20),
dup AS (SELECT doc_id, pos FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1),
marked AS (
  SELECT p.doc_id, p.pos, p.word,
         max(CASE WHEN dup.pos IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM p LEFT JOIN dup ON p.doc_id = dup.doc_id AND p.pos = dup.pos),
kept AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES["op3_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

ORACLES["op8_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.m AS component_id, d.doc_id = m.m AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id
"""

ORACLES["op10_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
small AS (SELECT doc_id, md5(substr(h, 2 * i + 1, 512)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 255, 0))) AS i FROM d)),
shared AS (SELECT DISTINCT doc_id FROM small SEMI JOIN (SELECT g FROM small GROUP BY g HAVING count(*) > 1) USING (g)),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 399, 0))) AS i FROM d)),
again AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
dup AS (SELECT doc_id, i FROM w SEMI JOIN again USING (g)),
cut AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS fresh FROM dup),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM cut),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY doc_id, k),
lost AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
parts AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS a, s AS b FROM spans UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT p.doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS h FROM parts p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256,
       CAST(CASE WHEN shared.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS repeats_256
FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN shared ON shared.doc_id = d.doc_id
"""
