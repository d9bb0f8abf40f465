"""Mixing sources to target weights: capped water-filling, in DataFrame functions only.

Sources in code point order (null last) have the weights of a repeating list and share ``share`` of all words. No
source may give more than ``max_epochs`` times its size; what the clamped ones leave goes to the others in
proportion to their weights, and so on until none is above. The end point has a closed form: with the
sources ordered by size / weight, the first k are clamped for the smallest k at which the common level
(budget - caps of the first k) / (weights of the rest) reaches no cap any more. Two running sums over the
table of sources (one row each) give it.

A source's target is then whole repetitions of all its documents, and a part of a repetition. For the part,
documents come in the order of a seeded MD5 of their id, and those before the cut are taken whole; the cut
falls in one document, which gives its first words up to the target. The cut is found in two steps, so that
no task sees a whole source: sums over 4096 hash ranges of each source, then the rows of the one
range that holds the cut. Rows that share an id share a hash; at the cut they split what is left in
proportion to their sizes.

Cases: null text has size 0 and takes nothing; a source without words has target 0; a null id is hashed as an
empty text; with an empty table the result is empty. The choice depends on seed and data only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import BLANKS
from .store import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    df = sources.select("source", "source_size", weight.alias("weight")).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    full = Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    df = df.select(
        "*",
        (share * F.sum("source_size").over(full)).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("clamped"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    df = df.withColumn("level", (F.col("budget") - F.col("clamped")) / F.col("open_weight"))
    free = df.withColumn("free_level", F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level")))
    level = F.first("free_level", ignorenulls=True).over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return free.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap"))).alias("target"))


def plan(sized: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """One row a source: its target, whole repetitions, and the cut of the part.

    ``sized`` has (id, source, size, order_key), where order_key is ``key_of`` the id.
    """
    sources = materialise(water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **targets), "mix-sources")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("copies", whole).withColumn("need", F.floor(F.col("target")).cast("long") - F.col("copies") * F.col("source_size"))
    need = sources.select(F.col("source").alias("s"), "need")
    ranges = sized.groupBy("source", F.substring("order_key", 1, 3).alias("range")).agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("upto", F.sum("n").over(run)).join(need, F.col("source").eqNullSafe(F.col("s")))
    hit = ranges.filter((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need")))
    hit = materialise(hit.select(F.col("s").alias("s"), F.col("range").alias("r"), "need", (F.col("upto") - F.col("n")).alias("below")), "mix-ranges")
    rows = sized.join(hit, F.col("source").eqNullSafe(F.col("s")) & (F.substring("order_key", 1, 3) == F.col("r")))
    keys = rows.groupBy("source", "order_key").agg(F.sum("size").alias("n"), F.first("need").alias("need"), F.first("below").alias("below"))
    run = Window.partitionBy("source").orderBy("order_key").rowsBetween(Window.unboundedPreceding, 0)
    keys = keys.withColumn("upto", F.col("below") + F.sum("n").over(run))
    cut = keys.filter((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need")))
    cut = cut.select(F.col("source").alias("s"), F.col("order_key").alias("cut_key"), F.col("n").alias("cut_size"), (F.col("need") - F.col("upto") + F.col("n")).alias("cut_take"))
    return materialise(sources.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan")


def key_of(id_col: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))


def allot(sized: DataFrame, mix: DataFrame) -> DataFrame:
    """``sized`` with source_size, target, copies (whole) and part (words of the last, partial repetition)."""
    cut = F.when(F.col("cut_key").isNull() | (F.col("order_key") > F.col("cut_key")), F.lit(0).cast("long"))
    cut = cut.when(F.col("order_key") < F.col("cut_key"), F.col("size")).otherwise(F.expr("if(cut_size > 0, (size * cut_take) div cut_size, 0L)"))
    joined = sized.join(mix.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("part", cut).drop("s", "need", "cut_key", "cut_size", "cut_take")


def sized(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), key_of(F.col(id_col), seed).alias("order_key"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, chars_col: str | None = "n_chars", **targets) -> DataFrame:
    """The mixed rows in the columns of ``documents``: whole copies, and for the cut document its first words."""
    own = F.struct(*(documents[c] for c in documents.columns)).alias("row")
    wide = documents.select(own).select("row", F.col(f"row.{source_col}").alias("source"), size_of(F.col(f"row.{text_col}")).alias("size"), key_of(F.col(f"row.{id_col}"), seed).alias("order_key"))
    small = materialise(sized(documents, id_col, text_col, source_col, seed), "mix-sized")
    out = allot(wide, plan(small, seed, **targets))
    copies = F.transform(F.sequence(F.lit(1), F.col("copies").cast("int")), lambda _: F.lit(None).cast("long"))
    copies = F.when(F.col("copies") > 0, copies).otherwise(F.array().cast("array<long>"))
    parts = F.when(F.col("part") > 0, F.array(F.when(F.col("part") < F.col("size"), F.col("part")))).otherwise(F.array().cast("array<long>"))
    out = out.filter((F.col("size") > 0)).select("row", F.explode(F.concat(copies, parts)).alias("first"))
    start = F.regexp_extract(F.col(f"row.{text_col}"), r"^[\x20\x09-\x0D]*", 0)
    pieces = F.split(F.btrim(F.col(f"row.{text_col}"), F.lit(BLANKS)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    text = F.when(F.col("first").isNull(), F.col(f"row.{text_col}")).otherwise(F.concat(start, F.rtrim(F.array_join(F.slice(pieces, F.lit(1), F.coalesce("first", F.lit(0)).cast("int")), ""), F.lit(BLANKS))))
    new = {text_col: text}
    if chars_col in documents.columns:
        new[chars_col] = F.length(text).cast(documents.schema[chars_col].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in documents.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``."""
    rows = materialise(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sized")
    out = allot(rows, plan(rows))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))
