"""Heading lexicon, nearest centroid, and their cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, vectors


def classify_heading(heading: Column, lexicon: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Category of the phrase that starts first in the normalised heading; ties go to the first category by name."""
    lexicon = lexicon or fixed.LEXICON
    patterns = {c: r"\b(?:" + "|".join(lexicon[c]) + r")\b" for c in sorted(lexicon)}

    def pick(norm: Column) -> Column:
        """The first match of each category's phrases, then the least (place, category)."""
        found = F.array(*(F.struct(F.regexp_instr(norm, F.lit(p)).alias("place"), F.lit(c).alias("category")) for c, p in patterns.items()))
        return F.array_min(F.filter(found, lambda x: x["place"] > 0))["category"]

    return F.get(F.transform(F.array(text.normal_heading(heading)), pick), F.lit(0))


def score_centroids(items: DataFrame, centroids: DataFrame, item_id: str, vector: str, category: str = "category") -> DataFrame:
    """(item_id, category, similarity) for every item and every centroid.

    ``centroids`` has one row a category (a fixed handful), so it is crossed as the small side.
    """
    return items.select(item_id, vector).crossJoin(F.broadcast(centroids)).select(item_id, category, vectors.cosine(F.col(vector), F.col("centroid")).alias("similarity"))


def nearest_centroid(scores: DataFrame, item_id: str, threshold: float = fixed.CENTROID_THRESHOLD, category: str = "category") -> DataFrame:
    """(item_id, best, similarity, assigned): the best category, by name on ties; assigned only above the threshold."""
    top = F.min_by(category, F.struct(-F.col("similarity"), F.col(category)))
    best = scores.groupBy(item_id).agg(top.alias("best"), F.max("similarity").alias("similarity"))
    return best.withColumn("assigned", F.when(F.col("similarity") > threshold, F.col("best")))


def provenance(heading_category: Column, category: Column, similarity: Column, ceiling: float = fixed.LOW_CONFIDENCE_CEILING) -> Column:
    """struct(stage, confidence, similarity) of a classified clause."""
    shown = F.round(similarity, 4)
    row = lambda stage, confidence, s: F.struct(F.lit(stage).alias("stage"), F.lit(confidence).alias("confidence"), s.cast("double").alias("similarity"))
    none = F.lit(None)
    return (
        F.when(heading_category.isNotNull(), row("heading_match", "high", none))
        .when(category.isNull(), row("unclassified", "low", shown))
        .when(similarity.isNull(), row("centroid", "low", none))
        .when(similarity <= ceiling, row("centroid", "low", shown))
        .otherwise(row("centroid", "high", shown))
    )


def cascade(clauses: DataFrame, embed, centroids: DataFrame, clause_id: str = "clause_id", heading: str = "heading_path", body: str = "text", threshold: float = fixed.CENTROID_THRESHOLD) -> DataFrame:
    """Adds ``category`` and ``similarity``. Only clauses that the lexicon leaves open reach ``embed``.

    ``embed`` maps a DataFrame (id, text) to (id, embedding).
    """
    named = clauses.withColumn("heading_category", classify_heading(F.col(heading)))
    open_ = named.filter(F.col("heading_category").isNull())
    vectors_ = embed(open_.select(clause_id, F.col(body).alias("text")))
    found = nearest_centroid(score_centroids(vectors_, centroids, clause_id, "embedding"), clause_id, threshold)
    second = open_.join(found.select(clause_id, "assigned", "similarity"), clause_id, "left").withColumnRenamed("assigned", "category")
    first = named.filter(F.col("heading_category").isNotNull()).withColumn("category", F.col("heading_category")).withColumn("similarity", F.lit(None).cast("double"))
    columns = [*clauses.columns, "heading_category", "category", "similarity"]
    return first.select(*columns).unionByName(second.select(*columns))
