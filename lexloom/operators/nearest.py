"""Approximate nearest neighbours by an inverted file: vectors are stored by their nearest coarse centre, queries look into a few lists.

* ``build``: centres are fitted by k-means on a sample of at most ``SAMPLE_ROWS`` rows (the documented bound); every vector is then assigned and
  stored, partitioned by list. There are about as many lists as the square root of the number of vectors, ``MOST_LISTS`` at most.
* ``calibrate``: the exact neighbours of ``CALIBRATED`` vectors are sought among all; the number of lists that would have shown the share
  ``TARGET`` of them is the number to probe.
* ``search``: each query goes to the tasks that hold its ``probes`` nearest lists, once each (``distances.nearest``). Distances in
  these lists are exact, and with all lists probed so is the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import distances

SAMPLE_ROWS, MOST_LISTS, SEED = 100_000, 4096, 7
#: Vectors whose exact neighbours tell how many lists to look into, and the share of these neighbours that must be found.
CALIBRATED, TARGET = 200, 0.95


def fit(items: DataFrame, lists: int | None = None, vector: str = "embedding", sample: int = SAMPLE_ROWS) -> np.ndarray:
    """[list, component]: the centres; the number of lists follows the number of vectors."""
    rows = items.filter(F.col(vector).isNotNull())
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    lists = lists or min(MOST_LISTS, max(1, math.isqrt(n)))
    some = rows if n <= sample else rows.sample(fraction=sample / n, seed=SEED).limit(sample)
    some = some.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = KMeans(k=lists, seed=SEED, featuresCol="v", maxIter=10, initMode="random").fit(some)
    return np.stack(model.clusterCenters())


def _closest(rows: DataFrame, centres: np.ndarray, probes: int, vector: str) -> DataFrame:
    """``rows`` with ``lists``: the nearest centres, nearest first. A batch is one matrix product."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lists array<int>"
    norms = (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(names.index(vector)).cast(pa.list_(pa.float64())).flatten()).reshape(batch.num_rows, -1)
            far = norms[None, :] - 2 * x @ centres.T
            near = (far.argmin(axis=1)[:, None] if probes == 1 else np.argsort(far, axis=1, kind="stable")[:, :probes]).astype(np.int32)
            ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], names=[*names, "lists"])

    return rows.mapInArrow(run, schema)


def build(items: DataFrame, path: str, lists: int | None = None, vector: str = "embedding", sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Store (item_id, embedding, ...) partitioned by ``list``; returns the centres. Rows without a vector are left out.

    A list with very many vectors is dealt to several files by a salt, so that it is not one task.
    """
    rows = items.filter(F.col(vector).isNotNull())
    centres = fit(rows, lists, vector, sample)
    if not len(centres):
        rows.limit(0).withColumn("list", F.lit(0)).write.parquet(path)
        return centres
    own = _closest(rows, centres, 1, vector).withColumn("list", F.get("lists", F.lit(0))).drop("lists")
    own.repartition("list", F.pmod(F.xxhash64("item_id"), F.lit(4))).write.partitionBy("list").parquet(path)
    return centres


def calibrate(spark: SparkSession, path: str, centres: np.ndarray, k: int = fixed.POOL, target: float = TARGET, sample: int = CALIBRATED) -> int:
    """The least number of lists that hold the share ``target`` of the exact neighbours of a sample of stored vectors."""
    from .retrieve import knn

    index = spark.read.parquet(path).select("item_id", "embedding", "list", F.lit(0).alias("scope"))
    some = index.orderBy(F.xxhash64("item_id", F.lit(SEED))).limit(sample).select(F.col("item_id").alias("query_id"), "embedding", "scope")
    exact = knn(some, index, k).join(index.select("item_id", "list"), "item_id")
    lists = _closest(some.select("query_id", "embedding"), centres, max(1, len(centres)), "embedding").select("query_id", "lists")
    place = F.array_position("lists", F.col("list").cast("int"))
    needed = exact.join(F.broadcast(lists), "query_id").agg(F.percentile_approx(place, target, 10_000)).first()[0]
    return int(needed or 1)


def search(spark: SparkSession, queries: DataFrame, path: str, centres: np.ndarray, probes: int, k: int = fixed.POOL, digits: int = 6) -> DataFrame:
    """(query_id, item_id, distance, rank) of (query_id, embedding) against a stored index."""
    index = spark.read.parquet(path)
    if not len(centres):
        return queries.limit(0).select("query_id", F.lit(0).alias("item_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    asked = _closest(queries.select("query_id", "embedding"), centres, probes, "embedding")
    pairs = distances.nearest(asked.withColumnRenamed("lists", "scopes"), index.select(F.col("list").alias("scope"), "item_id", "embedding"), k, digits)
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "item_id")
    return pairs.select("query_id", "item_id", "distance", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact neighbours (query_id, item_id) that were found."""
    hits = exact.join(found.select("query_id", "item_id").withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
