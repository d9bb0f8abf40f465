"""Order of suffixes by a distributed difference-cover algorithm over strings of symbols.

A string is a set of rows (doc, idx, sym) with consecutive ``idx``; a gap ends one string and begins the next. Suffixes are compared
symbol by symbol, an end before any symbol.

* Down: positions whose index is 1 or 2 modulo 3 are sampled; their triples of names are sorted, and equal triples get one new
  name, their place in that order. The names of a sample are the string of the next level. Written in base 3, level k
  samples the indexes whose k lowest digits are all 1 or 2, and its names cover 3^k symbols; so a level is a filter, and its triples
  are 3^(k-1) apart. It stops where names cover as many symbols as are asked for.
* Up: a remaining suffix (digit 0) is its name and the rank of the sampled suffix after it. Sorted with those of digit 1 by (name, rank
  one step on), and with those of digit 2 by (name, name, rank two steps on), each suffix learns how many of the other kind come
  before it. The sums of these counts are the merged ranks: no task needs a comparison of its own.

Sorts are range partitions that end in (doc, idx), so equal keys are spread over tasks; a task numbers its own rows, and one row a
task (count, first and last key) goes to the driver to join them. Every sort is stored, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import mark, materialise, sweep

_LEAST = -(1 << 63)
_PLACES = "pid int, local long, start long, again boolean, ahead long"


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], flag: str | None) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition with its place, the place where its run of equal keys starts, whether the run has more rows, and the flags before it."""
    pid, at, start, ahead, last, held = TaskContext.get().partitionId(), 0, 0, 0, None, None

    def out(batch: pa.RecordBatch, columns: list[np.ndarray], more: bool) -> pa.RecordBatch:
        places, starts, counts = columns
        again = starts != places
        again[:-1] |= starts[1:] == starts[:-1]
        again[-1] |= more
        made = [pa.array(np.full(len(places), pid, np.int32)), pa.array(places), pa.array(starts), pa.array(again), pa.array(counts)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(c.split()[0] for c in _PLACES.split(", "))])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = np.stack([np.asarray(batch.column(k).cast(pa.int64()).fill_null(_LEAST)) for k in keys], axis=1)
        fresh = np.ones(n, bool)
        fresh[1:] = (values[1:] != values[:-1]).any(axis=1)
        fresh[0] = last is None or (values[0] != last).any()
        if held is not None:
            yield out(*held, not fresh[0])
        places = np.arange(at, at + n)
        starts = np.maximum.accumulate(np.where(fresh, places, start))
        flags = np.zeros(n, np.int64) if flag is None else np.asarray(batch.column(flag).cast(pa.int64()))
        counts = ahead + np.cumsum(flags) - flags
        at, start, ahead, last, held = at + n, int(starts[-1]), ahead + int(flags.sum()), values[-1], (batch, [places, starts, counts])
    if held is not None:
        yield out(*held, False)


def numbered(rows: DataFrame, order: list[str], keys: list[str], flag: str | None = None, tag: str = "suffixes-sorted") -> DataFrame:
    """``rows`` sorted by ``order`` (long columns), with ``at`` (place), ``name`` (place of the first of its run of equal ``keys``),
    ``repeated`` (whether the run has other rows) and ``before`` (rows before it whose ``flag`` is true)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + _PLACES
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = materialise(dealt.mapInArrow(lambda it: _runs(it, keys, flag), schema), tag, batch_rows=10_000)
    key = F.struct(*(F.coalesce(F.col(k).cast("long"), F.lit(_LEAST)).alias(k) for k in keys))
    last = (F.max("ahead") + F.max_by(F.col(flag).cast("long"), "local")) if flag else F.lit(0)
    ends = done.groupBy("pid").agg(F.count("*").alias("n"), F.min_by(key, "local").alias("first"), F.max_by(key, "local").alias("last"), F.max("start").alias("last_start"), last.alias("flags"))
    ends = sorted(ends.collect(), key=lambda r: r.pid)  # one row a task
    about, place, flags = [], 0, 0
    for i, r in enumerate(ends):
        joined = i > 0 and ends[i - 1].last == r.first
        run = about[-1]["run"] if joined else place
        goes_on = i + 1 < len(ends) and ends[i + 1].first == r.last
        about.append({"p": r.pid, "offset": place, "carry": run, "joined": joined, "last_start": r.last_start, "goes_on": goes_on, "flags": flags, "run": run if r.last_start == 0 else place + r.last_start})
        place, flags = place + r.n, flags + int(r.flags)
    schema = "p int, offset long, carry long, joined boolean, final long, goes_on boolean, flags_before long"
    of = spark.createDataFrame([(a["p"], a["offset"], a["carry"], a["joined"], a["last_start"], a["goes_on"], a["flags"]) for a in about], schema)
    out = done.join(F.broadcast(of), F.col("pid") == F.col("p"))
    head = F.col("start") == 0
    out = out.select(
        *rows.columns,
        (F.col("offset") + F.col("local")).alias("at"),
        F.when(head, F.col("carry")).otherwise(F.col("offset") + F.col("start")).alias("name"),
        (F.col("again") | (head & F.col("joined")) | ((F.col("start") == F.col("final")) & F.col("goes_on"))).alias("repeated"),
        (F.col("flags_before") + F.col("ahead")).alias("before"),
    )
    out.stored_at = done.stored_at
    return out


def _ahead(rows: DataFrame, col: str, step: int, far: int):
    """``col`` of the row ``far`` steps of ``step`` indexes on, null beyond the string's end."""
    w = Window.partitionBy("doc", F.col("idx") % step).orderBy("idx")
    reached = F.lead("idx", far).over(w) == F.col("idx") + far * step
    nearer = F.lit(True) if far == 1 else F.lead("idx", 1).over(w) == F.col("idx") + step
    return F.when(reached & nearer, F.lead(col, far).over(w))


def _digit(k: int):
    return F.floor(F.col("idx") / 3**k) % 3


def ranks(strings: DataFrame, symbols: int) -> DataFrame:
    """(doc, idx, rank): all suffixes in order of their first ``symbols`` symbols or more; suffixes equal in that many come in any order."""
    spark, begin, kept = strings.sparkSession, mark(), []
    levels = [strings.select("doc", "idx", F.col("sym").alias("name"))]
    while 3 ** (len(levels) - 1) < symbols:
        step = 3 ** (len(levels) - 1)
        now = levels[-1]
        triples = now.select("doc", "idx", F.col("name").alias("a"), _ahead(now, "name", step, 1).alias("b"), _ahead(now, "name", step, 2).alias("c"))
        sampled = triples.filter(_digit(len(levels) - 1) != 0)
        found = numbered(sampled, ["a", "b", "c", "doc", "idx"], ["a", "b", "c"], tag="suffixes-names")
        kept.append(found)
        levels.append(found.select("doc", "idx", "name"))
        sweep(spark, begin, *kept)
    rank = levels[-1].select("doc", "idx", F.col("name").alias("rank"))
    for k in range(len(levels) - 2, -1, -1):
        step = 3**k
        # both tables meet by document, where the steps ahead are taken too
        none = F.lit(None).cast("long")
        both = levels[k].withColumn("rank", none).unionByName(rank.withColumn("name", none)).repartition("doc")
        both = both.groupBy("doc", "idx").agg(F.max("name").alias("name"), F.max("rank").alias("rank"))
        both = both.select("doc", "idx", "name", "rank", _digit(k).cast("int").alias("kind"), _ahead(both, "name", step, 1).alias("next"), _ahead(both, "rank", step, 1).alias("one"), _ahead(both, "rank", step, 2).alias("two"))
        both = materialise(both, "suffixes-level", batch_rows=10_000)
        zero = (F.col("kind") == 0).alias("zero")
        with_one = numbered(both.filter("kind <> 2").select("doc", "idx", "rank", "name", "one", zero), ["name", "one", "doc", "idx"], ["name", "one"], "zero", "suffixes-merge")
        with_two = numbered(both.filter("kind <> 1").select("doc", "idx", "rank", "name", "next", "two", zero), ["name", "next", "two", "doc", "idx"], ["name", "next", "two"], "zero", "suffixes-merge")
        # a remaining suffix: those of its own kind before it (counted once), of the first kind, of the second
        first = with_one.select("doc", "idx", F.when(F.col("zero"), F.col("at")).otherwise(F.col("rank") + F.col("before")).alias("part"))
        second = with_two.select("doc", "idx", F.when(F.col("zero"), F.col("at") - F.col("before")).otherwise(F.col("rank") + F.col("before")).alias("part"))
        rank = materialise(first.unionByName(second).groupBy("doc", "idx").agg(F.sum("part").alias("rank")), "suffixes-ranks", batch_rows=10_000)
        sweep(spark, begin, rank, *kept[:k])
    return rank
