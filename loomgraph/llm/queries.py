"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op1_bpe
from .fingerprints import op4_fingerprints
from .langid import op6_language_id
from .mixing import op5_mixing
from .phrases import ORACLE as PHRASES_SQL
from .phrases import op13_phrases
from .pii import op7_pii
from .quality import op3_quality
from .simhash import op10_simhash
from .substrings import op9_substrings
from .token_files import op2_token_files
from .topk import op8_topk
from .toxicity import op11_toxicity
from .turns import op12_turns

QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_files, op3_quality, op4_fingerprints, op5_mixing, op6_language_id, op7_pii, op8_topk, op9_substrings, op10_simhash, op11_toxicity, op12_turns, op13_phrases)}

ORACLES: dict[str, str] = {
    "op13_phrases": PHRASES_SQL,
    "op8_topk": """WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score FROM v q JOIN v d ON q.r <> d.r AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op9_substrings": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, t.i, array_to_string(w[t.i:t.i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT g.doc_id, g.i + r.k AS i FROM g JOIN m USING (g), range(0, 13) AS r(k) WHERE m.first < g.doc_id),
x AS (SELECT doc_id, t.i, w[t.i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
