"""Dataset preparation: flatten, deduplicate, split by group, sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed, text
from . import prefix
from .retrieve import small_side


def flatten_answers(raw: DataFrame) -> DataFrame:
    """(contract, category, text, answer_start, context) of nested question-answer JSON; impossible questions go."""
    p = raw.select(F.explode("data").alias("d")).select(F.col("d.title").alias("contract"), F.explode("d.paragraphs").alias("p"))
    q = p.select("contract", F.col("p.context").alias("context"), F.explode("p.qas").alias("q")).filter(~F.coalesce("q.is_impossible", F.lit(True)))
    a = q.select("contract", "context", F.element_at(F.split("q.id", "__"), -1).alias("category"), F.explode("q.answers").alias("a"))
    return a.select("contract", "category", text.squeeze(F.col("a.text")).alias("text"), F.col("a.answer_start").alias("answer_start"), "context").filter(F.length("text") >= fixed.MIN_SPAN_CHARS)


def first_of_each(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key, by the given order. The key is hashed, so what is compared is short."""
    df = rows.withColumn("__key", F.sha2(key, 256))
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).filter("__k = 1").drop("__key", "__k")


def group_split(rows: DataFrame, group: str, train: float = 0.70, validation: float = 0.15, seed: str = "42") -> DataFrame:
    """Adds ``split``; a group is never in two. The order of the groups is a seeded hash, ranked in blocks.

    Few groups meet the rows by broadcast: rows are not shuffled, and those of a large group stay spread.
    """
    groups = rows.select(group).distinct().withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(group).cast("string"))))
    n = groups.agg(F.count("*").alias("n"))
    block = F.coalesce(F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"), F.lit(-1))  # hashes are even, so 4096 ranges of them are
    place = prefix.sums_before(groups, ["__h", group], F.lit(1), "k", block).crossJoin(F.broadcast(n))
    first, second = F.floor(F.col("n") * train), F.floor(F.col("n") * validation)
    split = F.when(F.col("k") < first, "train").when(F.col("k") < first + second, "val").otherwise("test")
    return rows.join(small_side(place.select(group, split.alias("split"))), group)


def short_strata(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target, available) of the strata that have fewer rows than their target."""
    have = rows.groupBy(*keys).agg(F.count("*").alias("available"))
    return targets.join(have, keys, "left").withColumn("available", F.coalesce("available", F.lit(0))).filter(F.col("available") < F.col("target"))


def stratified_sample(rows: DataFrame, targets: DataFrame, keys: list[str], id_col: str, seed: str = "42", allow_short: bool = False) -> DataFrame:
    """``target`` rows of each stratum in the order of a seeded hash, with ``sample_id`` (prefix_%04d).

    A stratum with fewer rows than its target is an error; with ``allow_short`` all its rows are taken and marked ``short``.
    """
    short = short_strata(rows, targets, keys)
    if not allow_short and (found := short.limit(3).collect()):
        raise ValueError("too few rows: " + "; ".join(", ".join(f"{c}={r[c]}" for c in [*keys, "target", "available"]) for r in found))
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))), id_col)
    wanted = targets.join(short.select(*keys, F.lit(True).alias("short")), keys, "left").withColumn("short", F.coalesce("short", F.lit(False)))
    df = rows.join(wanted, keys).withColumn("k", F.row_number().over(order))
    return df.filter(F.col("k") <= F.col("target")).withColumn("sample_id", F.format_string("%s_%04d", F.concat_ws("_", *keys), F.col("k") - 1))


def status_counts(rows: DataFrame, status: str, known: tuple[str, ...] = ("ok", "flagging_failed", "needs_manual_review"), unknown: str = "UNKNOWN") -> DataFrame:
    """(status, n, expected): every known status, also with no rows, and any other that occurs; null counts as ``unknown``."""
    scaffold = rows.sparkSession.createDataFrame([(s,) for s in known], f"{status} string")
    counts = rows.groupBy(F.coalesce(F.col(status), F.lit(unknown)).alias(status)).agg(F.count("*").alias("n"))
    both = scaffold.join(counts, status, "full")
    return both.select(status, F.coalesce("n", F.lit(0)).alias("n"), F.col(status).isin(*known).alias("expected"))


def _picks(gaps: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each split (column) is among the first ``n`` picks, each of which takes the widest gap and narrows it by ``size``.

    The picks of a split go down in steps of ``size``, so the first ``n`` of all are those above a water level; the few around
    the level are picked one by one.
    """
    step = np.maximum(size, 1e-300)[:, None]
    top = np.cumsum(-np.sort(-gaps, axis=1), axis=1)
    level = ((top - (n * size)[:, None]) / np.arange(1, gaps.shape[1] + 1)).max(axis=1)[:, None]
    taken = np.where(size[:, None] > 0, np.maximum(np.floor((gaps - level) / step) - 2, 0), 0)
    left = np.where(size > 0, n - taken.sum(axis=1), 0)
    while (open_rows := np.flatnonzero(left > 0)).size:
        widest = np.round(gaps[open_rows] - step[open_rows] * taken[open_rows], 6).argmax(axis=1)
        taken[open_rows, widest] += 1
        left[open_rows] -= 1
    return taken


def _widest(gaps: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The split that pick ``n`` (from 0) takes."""
    return np.round(gaps - size[:, None] * _picks(gaps, size, n), 6).argmax(axis=1)


def deficit_assign(groups: DataFrame, group: str, size: str, shares: dict[str, float]) -> DataFrame:
    """(group, split): groups from the largest on (then by name), each to the split that is furthest below its share.

    Groups of one size are picks in closed form, so the fold goes over the distinct sizes only: of T rows there are at most
    sqrt(2 T) of those, and the fold holds one number a split. Ranks among the groups come from blocks, and each group is
    then decided by itself. A null size counts as 0.
    """
    names = list(shares)
    rows = groups.select(F.col(group).cast("string").alias("g"), F.coalesce(F.col(size), F.lit(0)).cast("double").alias("s"))
    total = rows.agg(F.sum("s").alias("total"))
    goal = np.array([shares[n] for n in names])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, before = np.zeros(len(goal)), 0
        for batch in batches:
            made = []
            for s, m, whole in zip(*(batch.column(c).to_pylist() for c in ("s", "m", "total"))):
                gaps = np.round(goal * whole - have, 6)
                made.append((s, before, gaps.tolist()))
                have = have + s * _picks(gaps[None], np.array([s]), np.array([m]))[0]
                before += m
            yield pa.RecordBatch.from_pydict({"s": [x[0] for x in made], "before": [x[1] for x in made], "gaps": [x[2] for x in made]})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = np.array(batch.column("gaps").to_pylist(), dtype=float).reshape(-1, len(goal))
            size, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("s", "n"))
            found = _widest(gaps, size, n)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array([names[i] for i in found], pa.string())], names=[group, "split"])

    sizes = rows.groupBy("s").agg(F.count("*").alias("m")).crossJoin(F.broadcast(total)).repartition(1).sortWithinPartitions(F.desc("s"))
    states = sizes.mapInArrow(fold, "s double, before long, gaps array<double>")
    ranked = prefix.sums_before(rows.withColumn("neg", -F.col("s")), ["neg", "g"], F.lit(1), "k").join(states, "s")
    return ranked.select("g", "s", (F.col("k") - F.col("before")).alias("n"), "gaps").mapInArrow(decide, StructType([StructField(group, StringType()), StructField("split", StringType())]))


def split_report(rows: DataFrame, split: str, category: str, splits: list[str], categories: list[str], least: int = 5) -> DataFrame:
    """(split, category, n, thin) with explicit zero cells."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(s, c) for s in splits for c in categories], f"{split} string, {category} string")
    counts = rows.groupBy(split, category).agg(F.count("*").alias("n"))
    df = grid.join(counts, [split, category], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return df.withColumn("thin", F.col("n") < least)


def resume(rows: DataFrame, done: DataFrame, key: str, status: str = "label_status") -> DataFrame:
    """Rows that are not yet labelled ``ok``."""
    return rows.join(done.filter(F.col(status) == "ok").select(key), key, "left_anti")


def missing_fields(rows: DataFrame, *required: str) -> DataFrame:
    """Adds ``missing``: the required fields that are null."""
    return rows.withColumn("missing", F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in required))), ","))
