"""Stored indexes and versioned tables: grounding over many scopes, approximate neighbours, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import fixed
from ..operators import contracts, nearest, retrieve
from ..sources.snapshots import Snapshots
from .base import Derived, query, spread, table
from .retrieval import _FREQ, _L2, _VECTORS, _letters

#: A clause an order; the customer is the contract. Words repeat inside a contract, so that rankings have something to weigh.
_CLAUSES = Derived(
    "SELECT o_custkey AS scope, o_orderkey AS item_id, concat('order ', o_orderpriority, ' part', o_orderkey % 7, ' status ', o_orderstatus, ' part', o_orderkey % 3) AS text, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS severity FROM orders"
)


@query(
    rf"""WITH c AS (SELECT *, regexp_extract_all(lower(text), '{fixed.WORD}') AS words, lower(text) AS t FROM {_CLAUSES.sql}), items AS (SELECT scope, item_id, words, t, {_FREQ} AS e FROM c),
    asked AS (SELECT scope, item_id AS query_id, words, t, {_FREQ} AS e FROM c WHERE severity IN ('high', 'medium')),
    tf AS (SELECT scope, item_id, term, count(*) AS tf FROM (SELECT scope, item_id, unnest(words) AS term FROM items) GROUP BY ALL),
    sizes AS (SELECT scope, count(*) AS n, avg(len(words)) AS avgdl FROM items GROUP BY scope),
    raw AS (SELECT tf.scope, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN sizes USING (scope) GROUP BY ALL),
    low AS (SELECT scope, 0.25 * avg(raw) AS low FROM raw GROUP BY scope),
    idf AS (SELECT scope, term, CASE WHEN raw < 0 THEN low ELSE raw END AS idf FROM raw JOIN low USING (scope)),
    q AS (SELECT scope, query_id, term, count(*) AS times FROM (SELECT scope, query_id, unnest(words) AS term FROM asked) GROUP BY ALL),
    scored AS (SELECT q.query_id, q.scope, tf.item_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avgdl))), 6) AS score
      FROM q JOIN tf USING (scope, term) JOIN idf USING (scope, term) JOIN items ON items.scope = q.scope AND items.item_id = tf.item_id JOIN sizes ON sizes.scope = q.scope GROUP BY ALL),
    bm AS (SELECT query_id, scope, item_id, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, item_id) AS rank FROM scored),
    vec AS (SELECT query_id, scope, item_id, row_number() OVER (PARTITION BY query_id, scope ORDER BY distance, item_id) AS rank FROM (SELECT a.query_id, a.scope, b.item_id, {_L2} AS distance FROM asked a JOIN items b USING (scope))),
    hy AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id, scope, item_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM bm WHERE rank <= 20 UNION ALL SELECT * FROM vec WHERE rank <= 20) GROUP BY ALL)),
    re AS (SELECT query_id, scope, item_id, round(1 / (1 + exp(-(8 * (len(list_intersect(list_distinct(a.words), b.words)) / len(list_distinct(a.words))) - 4))), 6) AS score FROM hy JOIN asked a USING (query_id, scope) JOIN items b USING (scope, item_id) WHERE rank <= 20)
    SELECT * FROM (SELECT query_id, scope, item_id, score, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, item_id) AS rank FROM re) WHERE rank <= 5"""
)
def grounding(spark, d):
    """Related clauses for every high or medium clause of every contract, each searched in its own contract."""
    clauses = _CLAUSES.df(spark, d)
    items = spread(clauses.select("scope", "item_id", "text", _letters(F.lower("text")).alias("embedding"), F.lit(None).cast("string").alias("category")))
    found = contracts.grounding(clauses, items, clauses.select("item_id", "severity"))
    return found.select("query_id", "scope", "item_id", "score", F.col("rank").cast("long").alias("rank"))


def _neighbours(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return v, v.filter(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "embedding")


def _indexed(spark, d, k: int, every: bool = False):
    v, q = _neighbours(spark, d)
    path = storage.new_path(spark, "ivf")
    centres = nearest.build(v, path)
    return nearest.search(spark, q, path, centres, len(centres) if every else nearest.calibrate(spark, path, centres, k), k)


@query()
def knn_ivf(spark, d):
    """The five nearest vectors by the inverted file, for every vector whose id is divisible by 20, against all."""
    return _indexed(spark, d, 5).select("query_id", "item_id", "distance", F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, true AS enough FROM embeddings")
def knn_ivf_recall(spark, d):
    """Whether the inverted file finds nine in ten of the exact neighbours or more."""
    v, q = _neighbours(spark, d)
    exact = retrieve.knn(q.withColumn("scope", F.lit("all")), v.withColumn("scope", F.lit("all")), 5)
    return nearest.recall(_indexed(spark, d, 5), exact).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query(
    f"""SELECT query_id, item_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank
      FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_L2} AS distance FROM {_VECTORS} a, {_VECTORS} b WHERE a.vec_id % 20 = 0)) WHERE rank <= 5"""
)
def knn_ivf_all_lists(spark, d):
    """With every list probed the inverted file is exact."""
    return _indexed(spark, d, 5, True).select("query_id", "item_id", "distance", F.col("rank").cast("long").alias("rank"))


def _versions(spark, d) -> Snapshots:
    """Three versions of the orders by customer: all; the orders of every seventh customer replaced by one row; every eleventh customer gone."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    found = Snapshots(spark, storage.new_path(spark, "snapshots"))
    found.create(o, ["o_custkey"])
    found.replace(o.filter("o_custkey % 7 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.lit("X").alias("o_orderstatus")))
    found.delete(o.filter("o_custkey % 11 = 0").select("o_custkey"))
    return found


_REPLACED = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT o_custkey, max(o_orderkey), 'X' FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey"


@query(f"SELECT * FROM ({_REPLACED}) WHERE o_custkey % 11 <> 0")
def snapshot_newest(spark, d):
    return _versions(spark, d).read()


@query(_REPLACED)
def snapshot_before(spark, d):
    """The version before the delete, read after it."""
    found = _versions(spark, d)
    return found.read(found.versions()[-2])
