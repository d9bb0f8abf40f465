"""State machines over streams: code sends, code checks and sessions, with state that ends by event time.

Keys meet in buckets. The open keys of a bucket are one packed table in the state store, so a call of Python and of the state server
serves all keys of a bucket that a trigger touches; more buckets (a parameter) make groups smaller. State survives a restart from the
checkpoint. A key is dropped once the watermark has passed the last moment at which it could matter: by the next call of its
bucket, or by the bucket's timer. Rows of one trigger are taken in the order of their time; rows behind the watermark are dropped by
Spark. The state store must hold several variables a key (``spark.sql.streaming.stateStore.providerClass``); ``drain`` sets it for the
query that it starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import fixed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 256
#: A trigger of a file source looks its files up in so many tasks at most; Spark's own limit amounts to a task a file.
LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "64"


class _Machine(StatefulProcessor):
    """The open keys of a bucket (``FIELDS`` and ``end_ms``, when they end), and one timer that clears a bucket whose keys have all ended."""

    FIELDS: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "packed binary")

    def held(self) -> pd.DataFrame:
        if self.state.exists():
            return pa.ipc.open_stream(pa.py_buffer(bytes(self.state.get()[0]))).read_pandas()
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("key", *self.FIELDS, "end_ms")})

    def keep(self, table: pd.DataFrame, timers: TimerValues) -> None:
        table = pa.Table.from_pandas(table[table["end_ms"] > timers.getCurrentWatermarkInMs()], preserve_index=False)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not len(table):
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(max(table.column("end_ms").to_pylist()))

    def judged(self, rows: pd.DataFrame, place: np.ndarray, old: pd.DataFrame) -> tuple[dict, dict]:
        """Result columns of the sorted rows, and ``FIELDS`` and ``end_ms`` of their keys; ``old`` has a row a key (zeros: a new one), ``place`` each row's key."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        rows = _sorted(key, rows, "at_s", "attempt")
        held = self.held()
        place, keys = pd.factorize(rows["key"])
        made, new = self.judged(rows, place, held.set_index("key").reindex(keys, fill_value=0))
        others = held[~held["key"].isin(keys)]
        new = pd.DataFrame({"key": keys, **new})
        self.keep(pd.concat([others, new]) if len(others) else new, timerValues)
        yield pd.DataFrame({"key": _named(key, rows["key"]), "attempt": rows["attempt"], **made})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _sorted(bucket: tuple, rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A bucket's rows by key and ``by``. Rows without a key are the bucket -1, and one key."""
    rows = pd.concat(list(rows), ignore_index=True)
    if bucket[0] < 0:
        rows["key"] = 0
    return rows.sort_values(["key", *by], ignore_index=True)


def _named(bucket: tuple, keys: pd.Series) -> pd.Series:
    return keys if bucket[0] >= 0 else pd.Series(None, keys.index, dtype="object")


class SendMachine(_Machine):
    """The send window of a key: when it began, the last send, and the number of sends."""

    FIELDS = ("first", "last", "n")

    def __init__(self, cap: int, window_s: int, cooldown_s: int):
        self.cap, self.window_s, self.cooldown_s = cap, window_s, cooldown_s

    def judged(self, rows, place, old):
        first, last, n = (old[c].tolist() for c in self.FIELDS)
        waits = []
        for k, at in zip(place.tolist(), rows["at_s"].tolist()):
            wait = self.cooldown_s - (at - last[k]) if n[k] else 0.0
            if wait <= 0:
                begins = not n[k] or at - first[k] >= self.window_s
                wait = self.window_s - (at - first[k]) if not begins and n[k] >= self.cap else 0.0
                if wait <= 0:
                    first[k], last[k], n[k] = (at, at, 1) if begins else (first[k], at, n[k] + 1)
            waits.append(wait)
        made = {"sent": [w <= 0 for w in waits], "retry_after_s": pd.array([int(w) + 1 if w > 0 else None for w in waits], dtype="Int64")}
        ends = [int(max(f + self.window_s, x + self.cooldown_s) * 1000) for f, x in zip(first, last)]
        return made, {"first": np.array(first, float), "last": np.array(last, float), "n": n, "end_ms": ends}


class VerifyMachine(_Machine):
    """The life of a code: its wrong tries so far, and whether it has ended. Up to its end all tries are wrong ones, so a running count judges them."""

    FIELDS = ("wrong", "over")

    def __init__(self, attempts: int, expiry_s: int, keep_s: int):
        self.attempts, self.expiry_s, self.keep_s = attempts, expiry_s, keep_s

    def judged(self, rows, place, old):
        running = lambda flags: pd.Series(flags).astype("int64").groupby(place).cumsum().to_numpy()
        correct = (rows["correct"] == True).to_numpy(bool)  # noqa: E712
        wrong = running(~correct) + old["wrong"].to_numpy("int64")[place]
        verdict = np.select([(rows["at_s"] - rows["issued_s"] >= self.expiry_s).to_numpy(bool), correct, wrong >= self.attempts], ["expired", "verified", "locked"], "wrong")
        ends = running(verdict != "wrong") + old["over"].to_numpy("int64")[place]
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True))
        until = rows["issued_s"].fillna(rows["at_s"]).to_numpy()[last] + self.expiry_s + self.keep_s
        return {"verdict": np.where(ends > (verdict != "wrong"), "cleared", verdict)}, {"wrong": wrong[last], "over": np.minimum(ends[last], 1), "end_ms": (until * 1000).astype("int64")}


class SessionMachine(_Machine):
    """The open sessions of the keys by their start. What a late row merges is retracted with ``n`` zero."""

    FIELDS = ("start_us", "last_us", "n")

    def __init__(self, gap_s: float):
        self.gap_us = int(gap_s * 1_000_000)

    def handleInputRows(self, key, rows, timerValues):
        rows = _sorted(key, rows, "at_us")
        before = self.held().drop(columns="end_ms")
        single = pd.DataFrame({"key": rows["key"], "start_us": rows["at_us"], "last_us": rows["at_us"], "n": 1})
        spans = pd.concat([before, single] if len(before) else [single], ignore_index=True).sort_values(["key", "start_us", "last_us"], ignore_index=True)
        reached = spans.groupby("key")["last_us"].cummax()
        begins = (spans["key"] != spans["key"].shift()) | (spans["start_us"] - reached.shift(fill_value=0) >= self.gap_us)
        after = spans.groupby(begins.cumsum()).agg({"key": "first", "start_us": "first", "last_us": "max", "n": "sum"})
        new = after[~pd.concat([before, after] if len(before) else [after]).duplicated().to_numpy()[len(before) :]]
        gone = before[~pd.concat([after, before])[["key", "start_us"]].duplicated().to_numpy()[len(after) :]].assign(n=0) if len(before) else before
        made = pd.concat([gone, new], ignore_index=True) if len(gone) else new
        self.keep(after.assign(end_ms=(after["last_us"] + self.gap_us) // 1000 + 1), timerValues)
        yield pd.DataFrame({"key": _named(key, made["key"]), "start_us": made["start_us"], "n": made["n"]})


def _transformed(rows: DataFrame, at: str, late: str, machine: StatefulProcessor, result: str, buckets: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    bucket = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return rows.withWatermark(at, late).withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(machine, result.format(**kinds), "Update", "EventTime")


def otp_sends(requests: DataFrame, user: str, request: str, at: str, late: str = "2 hours", cap: int = fixed.OTP_MAX_SENDS, window_s: int = fixed.OTP_WINDOW_S, cooldown_s: int = fixed.OTP_COOLDOWN_S, buckets: int = BUCKETS) -> DataFrame:
    """(user, request, sent, retry_after_s) of a stream of requests; ``at`` is a TIMESTAMP. The rules of ``quota.otp_sends``."""
    rows = requests.select(F.col(user).alias("key"), F.col(request).alias("attempt"), F.col(at).alias("at"), (F.unix_micros(at) / 1_000_000).alias("at_s"))
    made = _transformed(rows, "at", late, SendMachine(cap, window_s, cooldown_s), "key {key}, attempt {attempt}, sent boolean, retry_after_s long", buckets)
    return made.withColumnsRenamed({"key": "user", "attempt": "request"})


def otp_verify(tries: DataFrame, code: str, attempt: str, at: str, correct: str, issued: str, late: str = "2 hours", attempts: int = fixed.OTP_ATTEMPTS, expiry_s: int = fixed.OTP_EXPIRY_S, keep_s: int = 86_400, buckets: int = BUCKETS) -> DataFrame:
    """(code, attempt, verdict) of a stream of tries; ``at`` and ``issued`` are TIMESTAMPs. The rules of ``quota.otp_verify``.

    A code is remembered until ``keep_s`` after its expiry; a try later than that and the lateness is ``expired``, also where
    the code had been used.
    """
    seconds = lambda c: F.unix_micros(c) / 1_000_000
    rows = tries.select(F.col(code).alias("key"), F.col(attempt).alias("attempt"), F.col(at).alias("at"), seconds(at).alias("at_s"), F.col(correct).alias("correct"), seconds(issued).alias("issued_s"))
    made = _transformed(rows, "at", late, VerifyMachine(attempts, expiry_s, keep_s), "key {key}, attempt {attempt}, verdict string", buckets)
    return made.withColumnRenamed("key", "code")


def sessions(events: DataFrame, key: str, at: str, gap_s: float = 1800, late: str = "2 days", buckets: int = BUCKETS) -> DataFrame:
    """(key, start_us, n): changes of the sessions of a key, in any order of arrival within ``late``. ``n`` zero retracts a session that was merged.

    A row ``gap_s`` after the one before begins a session (``session_window`` would still merge that one instant).
    """
    rows = events.select(F.col(key).alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("at_us"))
    return _transformed(rows, "at", late, SessionMachine(gap_s), "key {key}, start_us long, n long", buckets)


def once(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that holds each batch once: a replayed batch finds its marker and writes nothing.

    A batch is one folder. Its rows are published by the commit of its own write, which ends with the marker; a batch that died
    before it has published nothing, and is overwritten when it is replayed.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/batch={number}"
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(folder)

    return sink


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Run a stream to the end of what its source holds now, into the ``once`` sink; ``twins.latest`` reads it back."""
    spark = stream.sparkSession
    ours = {PROVIDER: ROCKS, LISTING: LISTING_TASKS}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(once(path)).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    query.awaitTermination()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches in the sink."""
    return spark.read.parquet(path).drop("__batch", "batch")
