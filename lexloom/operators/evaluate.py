"""Retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

KS = (1, 3, 5)


def hits(rankings: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(method, query_id, k, hit) for every method, every query with a target, every k.

    ``rankings``: method, query_id, item_id, rank. ``truth``: query_id, item_id; a query with several targets is
    hit by any. Queries without targets are not rows (skipped, not missed).
    """
    methods = rankings.select("method").distinct()
    best = rankings.join(truth, ["query_id", "item_id"]).groupBy("method", "query_id").agg(F.min("rank").alias("best"))
    grid = truth.select("query_id").distinct().crossJoin(F.broadcast(methods)).join(best, ["method", "query_id"], "left")
    each = grid.select("method", "query_id", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"), "best")
    return each.select("method", "query_id", "k", F.coalesce(F.col("best") <= F.col("k"), F.lit(False)).alias("hit"))


def hit_rates(found: DataFrame) -> DataFrame:
    return found.groupBy("method", "k").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def disagreements(found: DataFrame) -> DataFrame:
    """(query_id, ks): the cut-offs at which methods differ."""
    differ = found.groupBy("query_id", "k").agg(F.min("hit").alias("lo"), F.max("hit").alias("hi")).filter("lo <> hi")
    return differ.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda k: k.cast("string")), ",").alias("ks"))


def ceiling(found: DataFrame) -> DataFrame:
    """(method, at_ceiling): every query hit at 1."""
    return found.filter("k = 1").groupBy("method").agg(F.coalesce(F.bool_and("hit"), F.lit(False)).alias("at_ceiling"))


def verdict(rates: DataFrame, new: str, old: str) -> DataFrame:
    """(wins, losses, verdict) of ``new`` against ``old`` over the cut-offs."""
    wide = rates.groupBy("k").pivot("method", [new, old]).agg(F.first("hit_rate"))
    counts = wide.agg(F.count_if(F.col(f"`{new}`") > F.col(f"`{old}`")).alias("wins"), F.count_if(F.col(f"`{new}`") < F.col(f"`{old}`")).alias("losses"))
    return counts.withColumn("verdict", F.when(F.col("wins") > F.col("losses"), "KEEP").when(F.col("losses") > F.col("wins"), "DROP").otherwise("DEFER"))


def binary_confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, precision and recall over rows with a prediction."""
    a, p = F.col(actual), F.col(predicted)
    df = rows.filter(p.isNotNull()).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    return df.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def per_class(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) for every label that occurs as truth; zero for zero denominators."""
    pairs = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    a = pairs.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    p = pairs.filter("p is not null").groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = a.join(p, "label", "left").withColumn("precision", zero(F.try_divide("tp", "predicted"))).withColumn("recall", zero(F.try_divide("tp", "support")))
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return df.select("label", "precision", "recall", f1.alias("f1"), "support")


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def accuracy_coverage(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Unclassified counts as wrong; coverage is the share with a prediction."""
    right = F.coalesce(F.col(actual) == F.col(predicted), F.lit(False))
    return rows.agg(F.avg(right.cast("double")).alias("accuracy"), F.avg(F.col(predicted).isNotNull().cast("double")).alias("coverage"), F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame, actual: str, predicted: str, labels: list, other="none") -> DataFrame:
    """One row a label (also those without rows), one column a prediction, missing cells 0."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(str(x),) for x in labels], "actual string")
    cells = rows.select(F.col(actual).cast("string").alias("actual"), F.coalesce(F.col(predicted).cast("string"), F.lit(other)).alias("p"))
    counts = cells.groupBy("actual").pivot("p", [*(str(x) for x in labels), other]).count()
    return F.broadcast(grid).join(counts, "actual", "left").fillna(0)


def threshold_gap(rows: DataFrame, thresholds: DataFrame, category: str = "category", score: str = "score", positive: str = "positive", least: int = 5) -> DataFrame:
    """(category, n, min_tp, max_fp, threshold, verdict) per category."""
    df = rows.groupBy(category).agg(F.count("*").alias("n"), F.min(F.when(F.col(positive), F.col(score))).alias("min_tp"), F.max(F.when(~F.col(positive), F.col(score))).alias("max_fp"))
    df = df.join(F.broadcast(thresholds), category, "left")
    tp, fp, t = F.col("min_tp"), F.col("max_fp"), F.col("threshold")
    out = F.when(F.col("n") < least, "INSUFFICIENT DATA").when(tp.isNull() | fp.isNull(), "ONE-SIDED").when((tp > t) & (t > fp), "SEPARATES").when(tp <= fp, "OVERLAP").otherwise("MISPLACED")
    return df.withColumn("verdict", out)


def severity_closeness(a: Column, b: Column) -> Column:
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(fixed.SEVERITIES) for x in (s, i)))
    return F.element_at(F.array(F.lit("EXACT"), F.lit("CLOSE"), F.lit("FAR")), F.abs(F.try_element_at(rank, a) - F.try_element_at(rank, b)) + 1)


def citation_resolved(body: Column, citation: Column) -> Column:
    """The citation occurs in the text after white space is evened out; empty ones don't."""
    c = text.squeeze(F.coalesce(citation, F.lit("")))
    return (c != "") & F.contains(text.squeeze(body), c)


def _places(hashed, k: int):
    return lambda at: hashed(at, k)


def containing(rows: DataFrame, body: str, passages: DataFrame, passage: str, row_id: str, passage_id: str, size: int = 5) -> DataFrame:
    """(row_id, passage_id) of the rows whose text contains a passage, by an equi-join on words inside it.

    Whatever surrounds a passage in a text, all its words (runs between spaces) but the first and the last are words of the
    text. The first ``size`` of these, or all, are its anchor; texts give the hashes of as many words from every
    place, and only those that anchors have go on to the exact test. Passages of one or two words have no such word
    and meet the texts directly.
    """
    words = F.split("p", " ")
    p = passages.filter(F.length(passage) > 0).select(F.col(passage_id).alias("p_id"), F.col(passage).alias("p"))
    p = p.withColumn("k", F.least(F.size(words) - 2, F.lit(size)))
    texts = rows.select(F.col(row_id).alias("r_id"), F.col(body).alias("b"))
    hashed = lambda at, k: F.xxhash64(F.lit(k), *(F.get(F.col("w"), at + j) for j in range(k)))
    anchor = F.lit(None).cast("long")
    every = []
    for k in range(1, size + 1):
        anchor = F.when(F.col("k") == k, hashed(F.lit(1), k)).otherwise(anchor)
        every.append(F.when(F.size("w") >= k + 2, F.transform(F.sequence(F.lit(1), F.size("w") - k - 1), _places(hashed, k))).otherwise(F.array().cast("array<long>")))
    anchors = p.filter("k > 0").withColumn("w", words).select("p_id", "p", "k", anchor.alias("anchor"))
    used = sorted(r[0] for r in anchors.select("k").distinct().collect())  # at most ``size`` numbers
    each = texts.select("r_id", F.split("b", " ").alias("w"))
    places = each.select("r_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<long>"), *(every[k - 1] for k in used)))).alias("anchor"))
    sieve = F.pmod("anchor", F.lit(1 << 20)).alias("sieve")  # 2^20 rows at most are broadcast
    places = places.withColumn("sieve", sieve).join(F.broadcast(anchors.select(sieve).distinct()), "sieve", "left_semi")
    pairs = places.join(anchors, "anchor").select("r_id", "p_id", "p").join(texts, "r_id")
    short = texts.join(p.filter("k <= 0").select("p_id", "p"), F.contains("b", "p"))
    both = pairs.filter(F.contains("b", "p")).select("r_id", "p_id").unionByName(short.select("r_id", "p_id"))
    return both.select(F.col("r_id").alias(row_id), F.col("p_id").alias(passage_id)).distinct()
