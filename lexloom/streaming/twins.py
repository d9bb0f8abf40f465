"""Structured Streaming versions of the time-windowed operators.

Event times must be TIMESTAMP (cast NTZ columns first) in a UTC session. Aggregations run in update mode with
the last write winning, so windows still open at the end of a bounded run are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators import observe

QUOTA = "user_id long, event_id long, day string, accepted boolean"


def events_stream(spark: SparkSession, folder: str, schema, ts: str = "ts") -> DataFrame:
    """A file source of Parquet events with a usable event time."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, *keys: str, width: str = "1 day", ts: str = "ts", late: str = "2 days") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, *keys: str, gap: str = "30 minutes", ts: str = "ts", late: str = "2 days") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def timing_events(lines: DataFrame) -> DataFrame:
    return observe.parse_timing(lines)


def timing_sketches(events: DataFrame, value: str, *keys: str, width: str = "1 day", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """(start, keys, n, sketch) of a stream: one sketch a window, to be merged by ``observe.merged_percentiles``."""
    w = observe.sketched(events.withWatermark(ts, late), value, F.window(ts, width).alias("window"), *keys)
    return w.select(F.col("window.start").alias("start"), *keys, "n", "sketch")


def stateful_quota(events: DataFrame, limit: int = fixed.DAILY_UPLOADS, buckets: int = 256) -> DataFrame:
    """(user_id, event_id, day, accepted): a counter per user and UTC day that lives until it is not needed.

    Events of one trigger are taken in the order of their time. A day's state ends by event time, two days
    after the day (a timeout by processing time would keep an ``availableNow`` run going for ever). Users meet in ``buckets``
    groups a day, whose state holds one counter a user: a call of Python serves many users, and more buckets make groups smaller.
    """

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = pd.Series(*reversed(state.get), dtype="int64") if state.exists else pd.Series(dtype="int64")
        rows = pd.concat(list(parts)).sort_values(["user_id", "ts", "event_id"])
        place = rows.groupby("user_id").cumcount() + 1 + rows["user_id"].map(used).fillna(0).astype("int64")
        used = used.add(rows["user_id"].value_counts(), fill_value=0).astype("int64")
        state.update((used.index.tolist(), used.tolist()))
        end = int(pd.Timestamp(key[0], tz="UTC").timestamp() * 1000) + 3 * 86_400_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        user = rows["user_id"].astype("Int64") if key[1] >= 0 else pd.Series(pd.NA, rows.index, dtype="Int64")
        yield pd.DataFrame({"user_id": user, "event_id": rows["event_id"], "day": key[0], "accepted": place <= limit})

    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets)))  # events without a user are one user
    keyed = events.withWatermark("ts", "2 days").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("bucket", bucket).fillna(0, ["user_id"])
    return keyed.groupBy("day", "bucket").applyInPandasWithState(decide, QUOTA, "users array<long>, used array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Drain a stream with ``availableNow``; each batch is appended with its number, and ``latest`` reads it back."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "__batch", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("v")).select(*keys, "v.*") if values else rows.select(*keys).distinct()
