"""Pluggable models with deterministic offline defaults.

The defaults stand in for remote models so that everything around them can be run and tested; their scores
are their own and not those of any hosted model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors

Embedder = Callable[[DataFrame], DataFrame]
DIMENSIONS = 64


def hashed_embedding(rows: DataFrame, dims: int = DIMENSIONS) -> DataFrame:
    """(id..., embedding): L2-normalised signed feature hashing of the words of ``text``, in the JVM.

    Sums run over (id, place) before and after the shuffle; rows without words get zeros.
    """
    ids = [c for c in rows.columns if c != "text"]
    h = F.xxhash64("word")
    sign = F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    words = rows.select(*ids, F.explode_outer(text.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("word"))
    sums = words.select(*ids, F.when(F.col("word").isNotNull(), F.pmod(h, F.lit(dims))).otherwise(0).cast("int").alias("place"), F.when(F.col("word").isNotNull(), sign).otherwise(0.0).alias("x"))
    sums = sums.groupBy(*ids, "place").agg(F.sum("x").alias("x"))
    raw = sums.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_divide(F.try_element_at(F.col("m"), i), F.col("norm")), F.lit(0.0)).cast("float")
    return raw.select(*ids, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).alias("embedding"))


def cached(rows: DataFrame, cache: DataFrame, model: str, embed: Embedder) -> tuple[DataFrame, DataFrame]:
    """(all rows with embeddings, new cache rows): hits by (model, sha256 of the text); only distinct misses are embedded."""
    keyed = rows.withColumn("text_sha", F.sha2("text", 256))
    own = cache.filter(F.col("model") == model).select("text_sha", "embedding")
    hits = keyed.join(own, "text_sha")
    misses = keyed.join(own.select("text_sha"), "text_sha", "left_anti")
    fresh = embed(misses.select("text_sha", "text").dropDuplicates(["text_sha"])).withColumn("model", F.lit(model)).select("model", "text_sha", "embedding")
    done = hits.unionByName(misses.join(fresh.select("text_sha", "embedding"), "text_sha"))
    return done, fresh


def centroids(examples: DataFrame, cache: DataFrame, model: str, embed: Embedder) -> tuple[DataFrame, DataFrame]:
    """((category, centroid), new cache rows) from examples (category, text): built again only where they have changed.

    ``cache``: model, category, examples_sha, centroid. The key is a hash of a category's examples in order.
    """
    keyed = examples.groupBy("category").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("text")), "\u0001"), 256).alias("examples_sha"))
    own = cache.filter(F.col("model") == model).select("category", "examples_sha", "centroid")
    hits = keyed.join(own, ["category", "examples_sha"])
    changed = examples.join(keyed.join(own, ["category", "examples_sha"], "left_anti").select("category"), "category", "left_semi")
    texts = changed.select("category", F.sha2("text", 256).alias("ref"), "text").dropDuplicates(["category", "ref"])
    built = vectors.mean_vectors(embed(texts), "category", "embedding")
    fresh = built.join(keyed, "category").select(F.lit(model).alias("model"), "category", "examples_sha", "centroid")
    return hits.select("category", "centroid").unionByName(fresh.select("category", "centroid")), fresh


def rule_severity(body: Column) -> Column:
    """The offline assessor: severity by phrases of the clause."""
    low = F.lower(body)
    return (
        F.when(low.rlike(r"\b(?:unlimited|sole discretion|irrevocabl[ye]|waives? all)\b"), "high")
        .when(low.rlike(r"\b(?:indemnif|liab|terminat|penalt)"), "medium")
        .otherwise("low")
    )


def assess(clauses: DataFrame, body: str = "text") -> DataFrame:
    """Adds ``raw``: the assessor's JSON output."""
    s = rule_severity(F.col(body))
    return clauses.withColumn("raw", F.to_json(F.struct(s.alias("severity"), F.concat(F.lit("rule: "), s).alias("explanation"), F.col(body).alias("citation"))))
