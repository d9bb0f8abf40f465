"""Timing logs and their percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

#: Size of a quantile sketch: a rank error of about 0.2 %.
SKETCH_K = 1024
EVENT = "stage STRING, duration_ms DOUBLE, timestamp STRING, contract_id STRING, n_candidates INT, n_clauses INT"


def parse_timing(lines: DataFrame, column: str = "value") -> DataFrame:
    """Timing events of log lines; lines of another shape, broken JSON and missing or non-numeric durations are skipped."""
    raw = F.regexp_extract(F.col(column), fixed.TIMING, 1)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.duration_ms", "variant"))
    numeric = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    parsed = lines.filter((raw != "") & numeric).select(F.from_json(raw, EVENT).alias("e")).select("e.*")
    return parsed.filter(F.col("stage").isNotNull() & F.col("duration_ms").isNotNull()).withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, max, mean, p50 and p95 by nearest rank; without keys one row, with n = 0 and nulls for no rows."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("double")
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def sketched(rows: DataFrame, value: str, *keys: str | Column, k: int = SKETCH_K) -> DataFrame:
    """(keys, n, sketch): mergeable quantile sketches of fixed size, also of a stream in windows. The rank error of a quantile is about 2.3 / k."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_percentiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, p50, p95) of sketches (of windows, of batches) merged by keys; approximate."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return merged.select(*keys, "n", at(0.5).alias("p50"), at(0.95).alias("p95"))


def selected_percentiles(rows: DataFrame, value: str, *keys: str, k: int = SKETCH_K, margin: float = 0.02) -> DataFrame:
    """What ``percentiles`` gives, for keys of any size: two passes, none of which holds a key's values.

    A sketch brackets each percentile within ``margin`` of its rank, several times its error. The second pass counts what lies below
    the bracket and the distinct values inside it, combined before the shuffle, and picks the value of the exact rank. Where
    a sketch was wrong nonetheless, the key is computed again by ``percentiles``. Values are not NaN.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("v"))
    stats = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.kll_sketch_agg_double("v", k).alias("sketch"))
    quantile = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    bracket = lambda name, p: F.struct(F.lit(name).alias("name"), F.ceil(F.col("n") * p).alias("rank"), quantile(max(p - margin, 0.0)).alias("lo"), quantile(min(p + margin, 1.0)).alias("hi"))
    wanted = stats.filter("n > 0").select(*keys, F.explode(F.array(bracket("p50", 0.5), bracket("p95", 0.95))).alias("b"))
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in keys), F.lit(True))
    a, b = rows.alias("a"), wanted.alias("b")
    met = rows.crossJoin(F.broadcast(wanted)) if not keys else a.join(b, same(rows, wanted)).select("a.*", "b.b")  # without keys: two rows
    near = met.filter(F.col("v") <= F.col("b.hi")).groupBy(*keys, F.col("b.name").alias("name"), F.col("b.rank").alias("rank"), F.when(F.col("v") >= F.col("b.lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("v")))
    hits = near.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")) & F.col("v").isNotNull())
    found = hits.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == p, F.col("v"))).alias(p) for p in ("p50", "p95")))
    both = stats.drop("sketch").alias("s").join(found.alias("f"), same(stats, found), "left").select("s.*", "f.p50", "f.p95")
    missed = (F.col("n") > 0) & (F.col("p50").isNull() | F.col("p95").isNull())
    wrong = both.filter(missed).select(*keys)
    again = percentiles(rows.join(wrong, same(rows, wrong), "left_semi"), "v", *keys)
    return both.filter(~missed).unionByName(again if keys else again.filter("n > 0"))
