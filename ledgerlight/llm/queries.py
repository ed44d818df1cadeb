"""The queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, ctw, harmonic, hnsw, idfile, jaccard, lyndon, phrases, topk, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove(table(spark, sf_dir, "documents"))


def op4_lyndon_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon.remove(table(spark, sf_dir, "documents"))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), links=True)


def op7_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.read(spark, idfile.write(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_context_tree_weighting, op3_phrase_automata, op4_lyndon_suffix_array, op5_harmonic_packing, op6_jaccard_join, op7_hnsw_near_dedup, op8_bpe_transducer, op9_exact_topk, op10_id_files)}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for the operators that SQL can express; the others are tested against brute force, the library or held-out labels.
ORACLES: dict[str, str] = {
    "op3_phrase_automata": f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM x), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM f WHERE r > 1),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d), j AS (SELECT t.doc_id, t.word, t.k, gone.k AS g FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.k = gone.k),
a AS (SELECT doc_id, count(*) AS n, count(g) AS m, string_agg(CASE WHEN g IS NULL THEN word END, ' ' ORDER BY k) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id""",
    "op4_lyndon_suffix_array": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, j, substr(h, 2000 * j + 1, 2798) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS j FROM d)),
w AS (SELECT doc_id, 1000 * j + i AS i, md5(substr(x, 2 * i - 1, 800)) AS k FROM (SELECT doc_id, j, x, unnest(range(1, greatest(least(length(x) // 2 - 398, 1001), 1))) AS i FROM b)), g AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
n AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT *, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -999) > 400)::INT AS s FROM g)), p AS (SELECT doc_id, min(i) AS s, max(i) + 399 AS e FROM n GROUP BY doc_id, r),
q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f FROM p), a AS (SELECT q.doc_id, sum(e - s + 1) AS m, count(*) AS c, string_agg(substr(h, 2 * f + 1, 2 * (s - f - 1)), '' ORDER BY s) AS t, max(e) AS e FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(m, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(CASE WHEN c IS NULL THEN h ELSE t || substr(h, 2 * e + 1) END)) AS kept_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id""",
    "op6_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, coalesce(any_value(m.m), 0) AS n_links FROM r LEFT JOIN n ON n.doc_id = r.a LEFT JOIN (SELECT a, count(*) AS m FROM e GROUP BY a) m ON m.a = r.a GROUP BY r.a""",
    "op7_hnsw_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS component FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, component AS component_id, component = c.a AS kept FROM c LEFT JOIN n ON n.a = c.a""",
    "op9_exact_topk": """WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS p, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS w FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score FROM v q JOIN v c ON q.p = c.p AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}
