"""The registered queries of this subpackage."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .collocations import op12_collocations
from .decontaminate import op9_decontamination
from .html import op8_html_extraction
from .language import op2_language_id
from .near_dup import op3_near_dedup
from .packing import op11_packing
from .pii import op5_pii
from .sharding import op10_sharding
from .token_files import op6_token_files
from .topk import op1_exact_topk
from .urls import op7_url_filters
from .whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk, op2_language_id, op3_near_dedup, op4_byte_bpe, op5_pii, op6_token_files, op7_url_filters,
        op8_html_extraction, op9_decontamination, op10_sharding, op11_packing, op12_collocations, op13_whitening,
    )
}
#: SQL of four whole queries, by brute force: every vector against every query, every window by its text, every pair
#: of documents that share a shingle, every phrase. Trained models, merges by rank, files, and learned spans and templates have none.
TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20"""
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
HITS = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
p AS (SELECT DISTINCT item, size, array_to_string(w[k : k + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM i)),
d AS (SELECT doc_id, row_number() OVER () AS rid, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
s AS (SELECT DISTINCT size FROM p),
x AS (SELECT rid, k, s.size, array_to_string(w[k : k + s.size - 1], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM d) CROSS JOIN s WHERE k + s.size - 1 <= len(w)),
h AS (SELECT x.rid, x.k, x.size, p.item FROM x JOIN p ON p.size = x.size AND p.win = x.win),
n AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS place FROM (SELECT DISTINCT rid, k, size FROM h)) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""
CLASSES = f"""WITH RECURSIVE d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS s, count(*) AS c FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM d) GROUP BY 1, 2),
n AS (SELECT doc_id, sum(c) AS n FROM b GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS shared FROM b x JOIN b y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9
  UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.text = y.text AND x.doc_id < y.doc_id WHERE len(x.w) = 0),
g AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT doc_id AS u, doc_id AS root FROM d UNION SELECT g.v, r.root FROM r JOIN g ON g.u = r.u),
m AS (SELECT u, min(root) AS root FROM r GROUP BY 1)
SELECT documents.doc_id, m.root AS class_id FROM documents LEFT JOIN m ON m.u = documents.doc_id"""

_GRAM = " UNION ALL ".join(
    f"SELECT lang, {k} AS size, w[i : i + {k - 1}] AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p)" for k in range(1, 5)
)
PHRASES = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
f AS (SELECT lang, size, g, count(*) AS f FROM ({_GRAM}) GROUP BY ALL HAVING count(*) >= 30),
x AS (SELECT lang, size, g, max(f) AS longer FROM (SELECT lang, size - 1 AS size, g[1 : size - 1] AS g, f FROM f WHERE size > 2 UNION ALL SELECT lang, size - 1, g[2 : size], f FROM f WHERE size > 2) GROUP BY ALL),
c AS (SELECT f.lang, f.size, f.g, f.f AS a FROM f LEFT JOIN x ON x.lang = f.lang AND x.g = f.g WHERE f.size > 1 AND (longer IS NULL OR 100 * longer::HUGEINT < 80 * f.f::HUGEINT)),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f)::HUGEINT AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.g = k.g[1 : k.k] JOIN f r ON r.lang = k.lang AND r.g = k.g[k.k + 1 : k.size]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM b)
SELECT o.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""

ORACLES: dict[str, str] = {"op1_exact_topk": TOP_K, "op3_near_dedup": CLASSES, "op9_decontamination": HITS, "op12_collocations": PHRASES}
