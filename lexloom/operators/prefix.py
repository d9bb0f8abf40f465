"""Sums over all rows before a row, in one global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage


def sums_before(rows: DataFrame, order: list[str], value: Column, out: str, block: Column | None = None, below: int | None = None) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` (not negative) over the rows before each in ``order`` (unique; nulls first).

    Rows fall into blocks that follow the order. A block's sum is one row, the sums of the blocks before it are a window
    over those few rows, and a window in each block does the rest. ``block`` is a number that grows with ``order``, where the
    caller has one; otherwise blocks are range partitions, stored so that all readers see the same ones. With ``below``,
    only rows with a smaller ``out`` stay, and blocks beyond it are not read further.
    """
    if block is None:
        placed = storage.stored(rows.repartitionByRange(*order).withColumn("__block", F.spark_partition_id()), "prefix")
    else:
        placed = rows.withColumn("__block", block)
    totals = placed.groupBy("__block").agg(F.sum(value).alias("__sum"))
    earlier = F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__block", F.coalesce(earlier, F.lit(0)).alias("__offset"))
    if below is not None:
        offsets = offsets.filter(F.col("__offset") < below)
    within = F.sum(value).over(Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    inside = placed.join(F.broadcast(offsets), "__block").withColumn(out, (F.col("__offset") + F.coalesce(within, F.lit(0))).cast("long"))
    return (inside if below is None else inside.filter(F.col(out) < below)).drop("__block", "__offset")
