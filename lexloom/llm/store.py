"""Shared storage for intermediate tables, and small helpers for Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import mark, stored, sweep  # noqa: F401

#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Rows of an Arrow batch while a table is written here.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A key is hot if it holds more than one in so many of a table's rows; fewer than so many keys can be.
HOT_KEYS = 1000
#: Rows of the sample that finds hot keys.
SAMPLE = 1 << 20
#: Rows of a sieve at most.
SIEVE = 1 << 20


def materialise(df: DataFrame, tag: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``storage.stored`` with small Arrow batches: whole texts are long, so these keep workers and the JVM's buffers small."""
    spark = df.sparkSession
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(batch_rows))
    try:
        return stored(df, tag)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def sieve(ids: DataFrame, col: str) -> DataFrame:
    """(sieve): the numbers below ``SIEVE`` that hashes of the ids leave, for a broadcast join before the exact one.

    Wide rows whose id leaves none of them need no shuffle. With many more ids than ``SIEVE`` all rows pass it.
    """
    return F.broadcast(ids.select(sieve_of(F.col(col)).alias("sieve")).distinct())


def sieve_of(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SIEVE))


def hot_keys(rows: DataFrame, on: list[str], by: str) -> list[int]:
    """Hashes of the keys that hold more than one in ``HOT_KEYS`` of the rows, by a sample of about ``SAMPLE`` rows.

    There are fewer than ``HOT_KEYS`` of them at any size. ``by`` is a column by which the rows of a key differ. The
    sample decides only where rows are dealt to, never what comes out.
    """
    total = rows.count()
    some = rows if total <= SAMPLE else rows.filter(F.pmod(F.xxhash64(by, F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total))
    counts = some.groupBy(F.xxhash64(*on).alias("key")).agg(F.count("*").alias("n"))
    least = max(2, min(total, SAMPLE) // HOT_KEYS)
    return [r.key for r in counts.filter(F.col("n") > least).select("key").collect()]  # fewer than HOT_KEYS rows


def hot_join(left: DataFrame, right: DataFrame, on: list[str], by: str) -> DataFrame:
    """``left`` joined with ``right``, which has one narrow row a key; ``left`` is best a stored table.

    Rows of hot keys meet by broadcast (of fewer than ``HOT_KEYS`` rows), all others by a shuffle without a hot key.
    """
    keys = hot_keys(left, on, by)
    if not keys:
        return left.join(right, on)
    hot = F.xxhash64(*on).isin(keys)
    return left.filter(hot).join(F.broadcast(right.filter(hot)), on).unionByName(left.filter(~hot).join(right.filter(~hot), on))


def shared_tokens(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (token, ...) whose token occurs in more than one of them, with ``n``, how many.

    One shuffle. Hot tokens need none: a sample has shown them repeatedly, and their ``n`` is the largest number there is.
    """
    keys = hot_keys(rows, ["token"], by)
    hot = F.xxhash64("token").isin(keys) if keys else F.lit(False)
    cool = rows.filter(~hot).withColumn("n", F.count("*").over(Window.partitionBy("token"))).filter("n > 1")
    return cool.unionByName(rows.filter(hot).withColumn("n", F.lit((1 << 63) - 1))) if keys else cool


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of few rows, so that the Python objects of one slice stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
