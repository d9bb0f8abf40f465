"""Time-windowed counters and small state machines, in batch form.

Closed forms where they exist. The others run over islands: stretches of a key's events that nothing before them can influence, found
by window functions, so that a key with very many events is many small pieces of work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import prefix


def daily_quota(events: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", limit: int = fixed.DAILY_UPLOADS) -> DataFrame:
    """Adds ``day``, ``accepted`` (among the first ``limit`` of the user's UTC day) and ``reset_at``.

    Only accepted events use up the quota, and those are always the first ones.
    """
    df = events.withColumn("day", F.to_date(ts))
    place = F.row_number().over(Window.partitionBy(user, "day").orderBy(ts, tie))
    return df.withColumn("accepted", place <= limit).withColumn("reset_at", F.date_add("day", 1))


def fixed_floor_pace(calls: DataFrame, key: str, order: str, arrival_s: str, floor_s: int = fixed.LLM_FLOOR_S) -> DataFrame:
    """Adds ``start_s``: the later of arrival and the previous start plus the floor."""
    w = Window.partitionBy(key).orderBy(arrival_s, order)
    i = F.row_number().over(w)
    df = calls.withColumn("__i", i).withColumn("__lead", F.col(arrival_s) - floor_s * F.col("__i"))
    return df.withColumn("start_s", F.max("__lead").over(w) + floor_s * F.col("__i")).drop("__i", "__lead")


def _islands(events: DataFrame, key: str, order: list[str], fresh: Column) -> DataFrame:
    """Adds ``__island``: how many events of the key, in order, are ``fresh`` (nothing before them matters) up to this one."""
    return events.withColumn("__island", F.sum(fresh.cast("int")).over(Window.partitionBy(key).orderBy(*order)))


def _by_island(events: DataFrame, key: str, order: list[str], fields: list[str], work: Callable[..., list[np.ndarray]], result: str) -> DataFrame:
    """(key, order's last column, result...): ``work`` on the sorted columns of each island. A key's islands are tasks of their own."""
    last = order[-1]
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, last)}
    names = [c.split()[0] for c in result.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        made = work(*(np.asarray(group.column(f).cast(pa.float64())) for f in fields))
        return pa.table({key: group.column(key), last: group.column(last), **dict(zip(names, made))})

    columns = dict.fromkeys([key, *order, *fields, "__island"])
    return events.select(*columns).groupBy(key, "__island").applyInArrow(run, f"{key} {kinds[key]}, {last} {kinds[last]}, {result}")


def token_pace(calls: DataFrame, key: str, order: str, arrival_s: str, tokens: str, window_s: int = fixed.PACE_WINDOW_S, budget: int = fixed.PACE_TOKENS, floor_s: int = fixed.PACE_FLOOR_S) -> DataFrame:
    """(key, order, start_s): calls of a key start in order of arrival, ``floor_s`` apart at least, and one that would
    exceed the token budget of the last ``window_s`` waits until the oldest call in that window leaves it.

    No call waits longer than ``window_s`` after the later of its arrival and the start before, which bounds every start by a prefix
    maximum. A call that arrives ``window_s`` after the bound of the one before finds an empty window: an island begins. Inside
    an island the calls in the window are a range of the starts so far, and their tokens a difference of prefix sums.
    """
    w = Window.partitionBy(key).orderBy(arrival_s, order)
    place = F.row_number().over(w)
    latest = F.max(F.col(arrival_s) - window_s * F.col("__place")).over(w) + window_s * (F.col("__place") + 1)
    bounded = calls.withColumn("__place", place).withColumn("__latest", latest)
    fresh = F.coalesce(F.col(arrival_s) >= F.lag("__latest").over(w) + window_s, F.lit(True))

    def work(arrivals: np.ndarray, amounts: np.ndarray) -> list[np.ndarray]:
        spent = np.concatenate([[0.0], np.cumsum(amounts)])
        starts = np.full(len(arrivals), -np.inf)
        for k, arrival in enumerate(arrivals):
            ready = max(arrival, starts[k - 1]) if k else arrival
            oldest = int(np.searchsorted(starts[:k], ready - window_s, "right"))
            crowded = oldest < k and spent[k + 1] - spent[oldest] > budget
            starts[k] = max(ready, starts[k - 1] + floor_s if k else ready, starts[oldest] + window_s if crowded else ready)
        return [starts]

    islands = _islands(bounded, key, [arrival_s, order], fresh)
    return _by_island(islands, key, [arrival_s, order], [arrival_s, tokens], work, "start_s double")


def otp_sends(requests: DataFrame, key: str, order: str, at_s: str, cap: int = fixed.OTP_MAX_SENDS, window_s: int = fixed.OTP_WINDOW_S, cooldown_s: int = fixed.OTP_COOLDOWN_S) -> DataFrame:
    """(key, order, sent, retry_after_s): cooldown between sends, and a cap in a window anchored at its first send.

    A request ``window_s`` after the one before it meets neither a cooldown nor a window: an island begins.
    """
    w = Window.partitionBy(key).orderBy(at_s, order)
    fresh = F.coalesce(F.col(at_s) - F.lag(at_s).over(w) >= max(window_s, cooldown_s), F.lit(True))

    def work(at: np.ndarray) -> list:
        sent, wait, sends = [], [], []
        for t in at:
            cooling = cooldown_s - (t - sends[-1]) if sends else 0
            if sends and t - sends[0] >= window_s and cooling <= 0:
                sends = []  # a new window, anchored at this send
            full = window_s - (t - sends[0]) if len(sends) >= cap else 0
            left = cooling if cooling > 0 else full
            sent.append(left <= 0)
            wait.append(int(left) + 1 if left > 0 else None)
            sends += [t] if left <= 0 else []
        return [pa.array(sent, pa.bool_()), pa.array(wait, pa.int64())]

    return _by_island(_islands(requests, key, [at_s, order], fresh), key, [at_s, order], [at_s], work, "sent boolean, retry_after_s long")


def otp_verify(tries: DataFrame, key: str, order: str, at_s: str, correct: str, issued_s: str, attempts: int = fixed.OTP_ATTEMPTS, expiry_s: int = fixed.OTP_EXPIRY_S) -> DataFrame:
    """(key, order, verdict): verified, wrong, locked (the wrong try that uses up the attempts), expired (from the second of expiry on), or cleared.

    Up to the first try that ends a code's life all tries are wrong ones, so their number is a running count and no fold is needed.
    """
    w = Window.partitionBy(key).orderBy(at_s, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wrong = F.count_if(~F.col(correct)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    verdict = F.when(F.col(at_s) - F.col(issued_s) >= expiry_s, "expired").when(F.col(correct), "verified").when(wrong >= attempts, "locked").otherwise("wrong")
    judged = tries.withColumn("__verdict", verdict)
    over = F.coalesce(F.max(F.col("__verdict") != "wrong").over(before), F.lit(False))
    return judged.select(key, order, F.when(over, "cleared").otherwise(F.col("__verdict")).alias("verdict"))


def embedding_estimate(chunks: DataFrame, key: str, n_tokens: str) -> DataFrame:
    """(key, n_calls, tokens, seconds, over_budget) before an embedding run."""
    return chunks.groupBy(key).agg(F.count("*").alias("n_calls"), F.sum(n_tokens).cast("long").alias("tokens")).select(
        key, "n_calls", "tokens", (F.greatest(F.col("n_calls") - 1, F.lit(0)) * fixed.PACE_FLOOR_S).alias("seconds"), (F.col("tokens") > fixed.PACE_TOKENS).alias("over_budget")
    )


def budget_stop(rows: DataFrame, order: str, tokens: str, budget: int, key: str | None = None) -> DataFrame:
    """Rows whose predecessors' tokens are within the budget; without a key the order is one sequence, summed in blocks."""
    if key is None:
        return prefix.sums_before(rows, [order], F.col(tokens), "spent", below=budget)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent", F.coalesce(F.sum(tokens).over(w), F.lit(0)).cast("long")).filter(F.col("spent") < budget)
