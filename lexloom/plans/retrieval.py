"""Rankings, fusion, gating, centroid classification and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import storage
from ..functions import fixed, vectors
from ..operators import classify, evaluate, lexical, retrieve
from .base import Derived, Inline, query, spread, table

_WORD = fixed.WORD
_BM25 = rf"""items AS (SELECT lang AS scope, doc_id AS item_id, regexp_extract_all(lower(text), '{_WORD}') AS words FROM documents),
    tf AS (SELECT scope, item_id, term, count(*) AS tf FROM (SELECT scope, item_id, unnest(words) AS term FROM items) GROUP BY ALL),
    sizes AS (SELECT scope, count(*) AS n, avg(len(words)) AS avgdl FROM items GROUP BY scope),
    raw AS (SELECT tf.scope, term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN sizes USING (scope) GROUP BY ALL),
    low AS (SELECT scope, 0.25 * avg(raw) AS low FROM raw GROUP BY scope),
    idf AS (SELECT scope, term, CASE WHEN raw < 0 THEN low ELSE raw END AS idf FROM raw JOIN low USING (scope)),
    q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM benchmark) GROUP BY ALL),
    scored AS (SELECT query_id, tf.scope, tf.item_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avgdl))), 6) AS score
      FROM q JOIN tf USING (term) JOIN idf ON idf.scope = tf.scope AND idf.term = tf.term JOIN items ON items.scope = tf.scope AND items.item_id = tf.item_id JOIN sizes ON sizes.scope = tf.scope GROUP BY ALL),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, item_id) AS rank FROM scored)"""
_KEYWORDS = rf"""kw AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, item_id) AS rank FROM (
      SELECT q.query_id, d.scope, d.item_id, CAST(count(*) AS DOUBLE) AS score
      FROM (SELECT DISTINCT query_id, term FROM q) q JOIN (SELECT DISTINCT scope, item_id, term FROM tf) d USING (term) GROUP BY ALL))"""


def _items(spark, d):
    return spread(table(spark, d, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("item_id"), "text"))


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _long(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_BM25} SELECT query_id, scope, item_id, score, rank FROM bm WHERE rank <= 5")
def bm25_rank(spark, d):
    return _long(retrieve.bm25(_queries(spark, d), _items(spark, d))).select("query_id", "scope", "item_id", "score", "rank")


@query(f"WITH {_BM25} SELECT sizes.scope, n, round(avgdl, 6) AS avgdl, round(low, 6) AS floor FROM sizes JOIN low USING (scope)")
def bm25_stats(spark, d):
    items = _items(spark, d)
    stats, _ = lexical.statistics(lexical.build(items))
    return stats.select("scope", "n", F.round("avgdl", 6).alias("avgdl"), F.round("floor", 6).alias("floor"))


_TINY = Inline("scope string, item_id int, text string", ("a", 1, "alpha beta"), ("a", 2, "alpha gamma gamma"), ("a", 3, "alpha"), ("b", 4, "alpha"))
_TINYQ = Inline("query_id int, text string", (1, "alpha alpha gamma"), (2, "unknown"))


_TINY_BM25 = (
    _BM25.replace("FROM documents)", f"FROM {_TINY.sql})")
    .replace("lang AS scope, doc_id AS item_id", "scope, item_id")
    .replace("FROM benchmark)", f"FROM {_TINYQ.sql})")
    .replace("item_id AS query_id", "query_id")
)


@query(
    f"""WITH {_TINY_BM25} SELECT s.query_id, s.scope, s.item_id, coalesce(bm.score, 0) AS score
    FROM (SELECT * FROM (SELECT query_id FROM {_TINYQ.sql}), (SELECT scope, item_id FROM {_TINY.sql})) s LEFT JOIN bm USING (query_id, scope, item_id)"""
)
def bm25_edges(spark, d):
    """Frequent terms get the floor, repeated query terms count, unknown ones give 0, and scopes are apart."""
    return retrieve.bm25(_TINYQ.df(spark), _TINY.df(spark), None, zero_scores=True).select("query_id", "scope", "item_id", "score")


@query(f"WITH {_BM25}, {_KEYWORDS} SELECT query_id, scope, item_id, score, rank FROM kw WHERE rank <= 5")
def keyword_overlap_rank(spark, d):
    return _long(retrieve.keyword_overlap(_queries(spark, d), _items(spark, d))).select("query_id", "scope", "item_id", "score", "rank")


@query(
    f"""WITH {_BM25}, {_KEYWORDS}, f AS (SELECT query_id, scope, item_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, scope, item_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, scope, item_id, rank FROM kw WHERE rank <= 20) GROUP BY ALL)
    SELECT query_id, scope, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 20"""
)
def rrf_fusion(spark, d):
    q, i = _queries(spark, d), _items(spark, d)
    fused = retrieve.fuse(retrieve.bm25(q, i, fixed.POOL), retrieve.keyword_overlap(q, i, fixed.POOL), limit=fixed.POOL)
    return _long(fused).select("query_id", "scope", "item_id", "score", "rank")


_VECTORS = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_L2 = "round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"


@query(
    f"""SELECT query_id, item_id, distance, score, rank FROM (SELECT *, 1 / (1 + distance) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank
      FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_L2} AS distance FROM {_VECTORS} a JOIN {_VECTORS} b ON a.label = b.label WHERE a.vec_id % 20 = 0)) WHERE rank <= 20"""
)
def knn_exact_l2(spark, d):
    """Queries: every vector whose id is divisible by 20, against all vectors of its label (the scope)."""
    v = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("scope"), F.col("vec_id").alias("item_id"), "embedding")
    q = v.filter(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "scope", "embedding")
    return _long(retrieve.knn(q, v)).select("query_id", "item_id", "distance", "score", "rank")


@query(
    f"""SELECT query_id, item_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank
      FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_L2} AS distance FROM {_VECTORS} a, {_VECTORS} b WHERE a.vec_id % 20 = 0)) WHERE rank <= 5"""
)
def knn_global(spark, d):
    """The same queries against all vectors: blocks of queries meet every row, and each keeps its best five."""
    v = table(spark, d, "embeddings").select(F.lit("all").alias("scope"), F.col("vec_id").alias("item_id"), "embedding")
    q = v.filter(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "scope", "embedding")
    return _long(retrieve.knn(q, v, 5)).select("query_id", "item_id", "distance", "rank")


_CENTROIDS = """c AS (SELECT label, list(x ORDER BY place) AS centroid FROM (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(range(len(e))) AS place, unnest(e) AS x FROM (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)) GROUP BY ALL) GROUP BY label),
    s AS (SELECT v.vec_id, v.label AS truth, c.label, round(list_sum(list_transform(list_zip(v.e, c.centroid), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v.e, lambda x: x * x))) * sqrt(list_sum(list_transform(c.centroid, lambda x: x * x)))), 6) AS sim
      FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) v, c),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s) WHERE r = 1)"""


@query(f"WITH {_CENTROIDS} SELECT label, CAST(unnest(range(len(centroid))) AS INTEGER) AS place, round(unnest(centroid), 6) AS x FROM c")
def centroid_build(spark, d):
    c = vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("place", "x")).withColumn("x", F.round("x", 6))


def _best(spark, d, threshold: float):
    v = table(spark, d, "embeddings")
    c = vectors.mean_vectors(v, "label", "embedding")
    s = classify.score_centroids(v, c, "vec_id", "embedding", "label").withColumn("similarity", F.round("similarity", 6))
    return v.select("vec_id", F.col("label").alias("truth")).join(classify.nearest_centroid(s, "vec_id", threshold, "label"), "vec_id")


@query(f"WITH {_CENTROIDS} SELECT vec_id, truth, label AS best, sim AS similarity, CASE WHEN sim > 0.2 THEN label END AS assigned FROM b")
def centroid_classify(spark, d):
    return _best(spark, d, 0.2)


@query(f"WITH {_CENTROIDS} SELECT count(*) AS n, count(*) FILTER (sim > 0.5) AS assigned FROM b")
def centroid_gate(spark, d):
    return _best(spark, d, fixed.CENTROID_THRESHOLD).agg(F.count("*").alias("n"), F.count("assigned").alias("assigned"))


@query(
    f"""WITH {_CENTROIDS}, p AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'x' END AS heading, CASE WHEN vec_id % 5 > 0 THEN 'x' END AS category, CASE WHEN vec_id % 7 > 0 THEN floor(sim * 1000) / 500 END AS similarity FROM b)
    SELECT vec_id, CASE WHEN heading IS NOT NULL THEN 'heading_match' WHEN category IS NULL THEN 'unclassified' ELSE 'centroid' END AS stage, CASE WHEN heading IS NOT NULL OR (category IS NOT NULL AND similarity > 0.6) THEN 'high' ELSE 'low' END AS confidence,
    CASE WHEN heading IS NULL THEN round(similarity, 4) END AS similarity FROM p"""
)
def centroid_confidence(spark, d):
    p = _best(spark, d, 0.2).withColumn("s", F.when(F.col("vec_id") % 7 > 0, F.floor(F.col("similarity") * 1000) / 500))
    p = p.select("vec_id", classify.provenance(F.when(F.col("vec_id") % 4 == 0, "x"), F.when(F.col("vec_id") % 5 > 0, "x"), F.col("s")).alias("p"))
    return p.select("vec_id", "p.*")


_GATE = Derived("SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN 'Indemnification' WHEN 1 THEN 'Termination' WHEN 2 THEN 'Confidentiality' WHEN 3 THEN 'Limitation of Liability' WHEN 4 THEN 'Governing Law / Jurisdiction' WHEN 5 THEN 'Other' END AS category, CAST(vec_id % 101 AS DOUBLE) / 100 AS score FROM embeddings")
_LIMIT = "CASE category WHEN 'Indemnification' THEN 0.71::DOUBLE WHEN 'Termination' THEN 0.65 WHEN 'Confidentiality' THEN 0.68 WHEN 'Limitation of Liability' THEN 0.62 WHEN 'Governing Law / Jurisdiction' THEN 0.55 END"


@query(f"SELECT vec_id, {_LIMIT} AS threshold, coalesce(score >= {_LIMIT}, false) AS is_confident FROM {_GATE.sql}")
def threshold_gate(spark, d):
    return retrieve.gate(_GATE.df(spark, d), F.col("category"), F.col("score")).select("vec_id", "threshold", "is_confident")


_TRUTH = "truth AS (SELECT b.item_id AS query_id, d.doc_id AS item_id, d.lang AS scope FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FREQ = f"list_transform(string_split('{','.join(_LETTERS)}', ','), lambda c: CAST(100 * (length(t) - length(replace(t, c, ''))) AS DOUBLE) / greatest(length(t), 1))"
_HYBRID = f"""iv AS (SELECT lang AS scope, doc_id AS item_id, {_FREQ} AS e FROM (SELECT *, lower(text) AS t FROM documents)), qv AS (SELECT item_id AS query_id, {_FREQ} AS e FROM (SELECT *, lower(text) AS t FROM benchmark)),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY distance, item_id) AS rank FROM (SELECT query_id, scope, item_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM qv a, iv b)),
    hy AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id, scope, item_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, scope, item_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, scope, item_id, rank FROM vec WHERE rank <= 20) GROUP BY ALL)),
    qn AS (SELECT query_id, count(DISTINCT term) AS n FROM q GROUP BY query_id),
    re AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, item_id) AS rank FROM (SELECT hy.query_id, hy.scope, hy.item_id, round(1 / (1 + exp(-(8 * (coalesce(kw.score, 0) / n) - 4))), 6) AS score FROM hy JOIN qn USING (query_id) LEFT JOIN kw USING (query_id, scope, item_id) WHERE hy.rank <= 20))"""
_HITS = f"""{_BM25}, {_KEYWORDS}, {_TRUTH}, {_HYBRID},
    r AS (SELECT 'bm25' AS method, query_id, item_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT 'keyword', query_id, item_id, rank FROM kw WHERE rank <= 20 UNION ALL SELECT 'vector', query_id, item_id, rank FROM vec WHERE rank <= 20
      UNION ALL SELECT 'hybrid', query_id, item_id, rank FROM hy WHERE rank <= 20 UNION ALL SELECT 'reranked', query_id, item_id, rank FROM re WHERE rank <= 5),
    best AS (SELECT m.method, t.query_id, min(r.rank) AS best FROM (SELECT DISTINCT query_id FROM truth) t CROSS JOIN (SELECT DISTINCT method FROM r) m
      LEFT JOIN (SELECT r.* FROM r JOIN truth USING (query_id, item_id)) r ON r.method = m.method AND r.query_id = t.query_id GROUP BY ALL),
    hits AS (SELECT method, query_id, CAST(k AS INTEGER) AS k, coalesce(best <= k, false) AS hit FROM best, (SELECT unnest([1, 3, 5]) AS k))"""


def _letters(text):
    """The offline embedder of the evaluation: how often each letter occurs in a hundred characters."""
    n = F.greatest(F.length(text), F.lit(1))
    return F.array(*((100 * (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))))).cast("double") / n for c in _LETTERS))


def _lettered(docs, *keys: str):
    """(keys, embedding): ``_letters`` of the lower-case texts in one pass over their bytes, stored (26 numbers a text). Null texts have no vector."""
    first, last = _LETTERS.encode()[0], _LETTERS.encode()[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for low in batch.column("low"):
                if low.is_valid:
                    of = np.bincount(np.frombuffer(low.as_buffer(), np.uint8), minlength=256)
                    chars = of.sum() - of[0x80:0xC0].sum()  # all bytes but those that continue a character
                    made.append((100 * of[first : last + 1]) / max(1, chars))
                else:
                    made.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(made, pa.list_(pa.float64()))], names=[*keys, "embedding"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return storage.stored(docs.select(*keys, F.lower("text").alias("low")).mapInArrow(run, f"{kinds}, embedding array<double>"), "letters")


def _hits(spark, d):
    """Five rankings of the same pools: keywords, BM25, vectors, the last two fused, and those re-scored. A ranking that others use is stored: twenty rows a query and scope."""
    docs, items = _items(spark, d), _queries(spark, d)
    truth = storage.stored(evaluate.containing(docs, "text", items, "text", "item_id", "query_id"), "truth")
    low = F.lower("text")
    asked = items.crossJoin(F.broadcast(docs.select("scope").distinct())).select("query_id", "scope", _letters(low).alias("embedding"))
    near = storage.stored(retrieve.knn(asked, _lettered(docs, "scope", "item_id")), "near")
    words = storage.stored(retrieve.bm25(items, docs, fixed.POOL), "words")
    fused = storage.stored(retrieve.fuse(words, near, limit=fixed.POOL), "fused")
    full = retrieve.with_words(fused.select("query_id", "scope", "item_id"), items, docs, "query_id")
    again = retrieve.ranked(full.withColumn("score", F.round(retrieve.overlap_rerank(full), 6)), fixed.TOP_K)
    methods = {"bm25": words, "keyword": retrieve.keyword_overlap(items, docs, fixed.POOL), "vector": near, "hybrid": fused, "reranked": again}
    rankings = None
    for name, df in methods.items():
        df = df.select(F.lit(name).alias("method"), "query_id", "item_id", "rank")
        rankings = df if rankings is None else rankings.unionByName(df)
    return evaluate.hits(storage.stored(rankings, "rankings"), truth)


@query(f"WITH {_HITS} SELECT method, k, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate, count(*) AS n FROM hits GROUP BY method, k")
def hit_at_k(spark, d):
    return evaluate.hit_rates(_hits(spark, d)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"WITH {_HITS} SELECT query_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS ks FROM (SELECT query_id, k FROM hits GROUP BY ALL HAVING min(hit::INT) <> max(hit::INT)) GROUP BY query_id")
def disagreements(spark, d):
    return evaluate.disagreements(_hits(spark, d))


@query(f"WITH {_HITS} SELECT method, bool_and(hit) AS at_ceiling FROM hits WHERE k = 1 GROUP BY method")
def ceiling(spark, d):
    return evaluate.ceiling(_hits(spark, d))


@query(
    f"""WITH {_HITS}, rates AS (SELECT method, k, avg(CAST(hit AS DOUBLE)) AS rate FROM hits GROUP BY ALL),
    w AS (SELECT count(*) FILTER (a.rate > b.rate) AS wins, count(*) FILTER (a.rate < b.rate) AS losses FROM rates a JOIN rates b ON a.k = b.k AND a.method = 'bm25' AND b.method = 'keyword')
    SELECT wins, losses, CASE WHEN wins > losses THEN 'KEEP' WHEN losses > wins THEN 'DROP' ELSE 'DEFER' END AS verdict FROM w"""
)
def verdict(spark, d):
    return evaluate.verdict(evaluate.hit_rates(_hits(spark, d)), "bm25", "keyword")


@query(f"WITH {_CENTROIDS} SELECT round(avg(CASE WHEN sim > 0.2 AND label = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN sim > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n FROM b")
def accuracy_coverage(spark, d):
    out = evaluate.accuracy_coverage(_best(spark, d, 0.2), "truth", "assigned")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"), "n")


_PRF = f"""{_CENTROIDS}, p AS (SELECT truth, CASE WHEN sim > 0.2 THEN label END AS pred FROM b), l AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (pred = truth) AS tp FROM p GROUP BY truth),
    m AS (SELECT l.label, support, tp, (SELECT count(*) FROM p WHERE pred = l.label) AS predicted FROM l),
    prf AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM m),
    full_prf AS (SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM prf)"""


@query(f"WITH {_PRF} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM full_prf")
def per_class_prf(spark, d):
    out = evaluate.per_class(_best(spark, d, 0.2), "truth", "assigned")
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_PRF} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM full_prf")
def macro_f1(spark, d):
    out = evaluate.macro(evaluate.per_class(_best(spark, d, 0.2), "truth", "assigned"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(
    f"""WITH {_CENTROIDS}, p AS (SELECT CAST(truth AS VARCHAR) AS actual, coalesce(CASE WHEN sim > 0.2 THEN CAST(label AS VARCHAR) END, 'none') AS pred FROM b)
    SELECT a.actual, {", ".join(f'''count(*) FILTER (p.pred = '{x}') AS "{x}"''' for x in (*range(11), "none"))} FROM (SELECT CAST(unnest(range(11)) AS VARCHAR) AS actual) a LEFT JOIN p USING (actual) GROUP BY a.actual"""
)
def confusion(spark, d):
    """Label 10 does not occur: its row and column are zeros."""
    return evaluate.confusion_matrix(_best(spark, d, 0.2), "truth", "assigned", list(range(11)))


@query(
    f"""WITH {_CENTROIDS}, g AS (SELECT label AS category, count(*) AS n, min(CASE WHEN truth = label THEN sim END) AS min_tp, max(CASE WHEN truth <> label THEN sim END) AS max_fp FROM b GROUP BY label)
    SELECT category, n, min_tp, max_fp, 0.2::DOUBLE AS threshold, CASE WHEN n < 5 THEN 'INSUFFICIENT DATA' WHEN min_tp IS NULL OR max_fp IS NULL THEN 'ONE-SIDED' WHEN min_tp > 0.2 AND 0.2 > max_fp THEN 'SEPARATES' WHEN min_tp <= max_fp THEN 'OVERLAP' ELSE 'MISPLACED' END AS verdict FROM g"""
)
def threshold_gap(spark, d):
    rows = _best(spark, d, 0.2).select(F.col("best").alias("category"), F.col("similarity").alias("score"), (F.col("best") == F.col("truth")).alias("positive"))
    thresholds = rows.select("category").distinct().withColumn("threshold", F.lit(0.2))
    return evaluate.threshold_gap(rows, thresholds)


_CATEGORY = "CASE item_id % 5 WHEN 0 THEN 'Confidentiality' WHEN 1 THEN 'Governing Law / Jurisdiction' WHEN 2 THEN 'Indemnification' WHEN 3 THEN 'Limitation of Liability' ELSE 'Termination' END"


@query(
    f"""WITH {_BM25}, {_KEYWORDS}, {_HYBRID}, found AS (SELECT query_id, scope, item_id, {_CATEGORY} AS category, score, rank FROM re WHERE rank <= 5)
    SELECT *, {_LIMIT} AS threshold, score >= {_LIMIT} AS is_confident FROM found"""
)
def search_gated(spark, d):
    """Full hybrid search: benchmark passages in the scopes of their language peers, offline embedder and re-scorer."""
    low = F.lower("text")
    docs = _items(spark, d).withColumn("category", F.element_at(F.array(*(F.lit(c) for c in fixed.CATEGORIES)), F.pmod(F.col("item_id"), F.lit(5)).cast("int") + 1))
    queries = _queries(spark, d).crossJoin(F.broadcast(docs.select("scope").distinct())).withColumn("embedding", _letters(low))
    return _long(retrieve.search(queries, docs, vectors_of=_lettered(docs, "scope", "item_id"))).select("query_id", "scope", "item_id", "category", "score", "rank", "threshold", "is_confident")


@query(f"WITH {_BM25}, {_KEYWORDS}, {_HYBRID} SELECT query_id, scope, item_id, {_CATEGORY} AS category, 1 / (1 + distance) AS score, rank FROM vec WHERE rank <= 5")
def search_plain(spark, d):
    """Vector search alone, without fusion or re-scoring."""
    low = F.lower("text")
    docs = _items(spark, d).withColumn("category", F.element_at(F.array(*(F.lit(c) for c in fixed.CATEGORIES)), F.pmod(F.col("item_id"), F.lit(5)).cast("int") + 1))
    queries = _queries(spark, d).crossJoin(F.broadcast(docs.select("scope").distinct())).withColumn("embedding", _letters(low))
    found = retrieve.search(queries, docs, use_reranker=False, vectors_of=_lettered(docs, "scope", "item_id"))
    return _long(found).select("query_id", "scope", "item_id", "category", "score", "rank")


@query()
def pipeline_clauses(spark, d):
    """Chunk, classify, embed and flag all documents; one row a clause with its category and severity."""
    from ..operators import pipeline, providers

    seeds = spark.createDataFrame([(c, p) for c in fixed.LEXICON for p in fixed.LEXICON[c]], "category string, text string")
    centroids = vectors.mean_vectors(providers.hashed_embedding(seeds.select("category", "text")), "category", "embedding")
    pages = spread(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_number"), "text"))
    out = pipeline.run_pipeline(pages, centroids)
    return out.clauses.join(out.flags.select("clause_id", "severity"), "clause_id").select("doc_id", "chunk_ord", "heading_path", "category", "severity", "n_tokens")

