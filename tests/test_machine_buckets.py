"""State machines whose keys meet in buckets: over triggers and restarts, with rows without a key, and how many states there are."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import quota
from lexloom.streaming import machines, twins

START = 1_000_000_000
SCHEMA = "who string, id long, sec double, ok boolean"
MADE = {
    "sends": lambda s, buckets: machines.otp_sends(s, "who", "id", "at", buckets=buckets),
    "checks": lambda s, buckets: machines.otp_verify(s, "who", "id", "at", "ok", "issued", buckets=buckets),
    "sessions": lambda s, buckets: machines.sessions(s, "who", "at", late="10 days", buckets=buckets),
}


def run(spark, tmp_path, rows, kind, buckets, part=0):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={part}")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/part=*")
    stream = stream.withColumn("at", F.timestamp_seconds(F.col("sec") + START)).withColumn("issued", F.timestamp_seconds(F.lit(START)))
    machines.drain(MADE[kind](stream, buckets), out, checkpoint)
    return out


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


@pytest.mark.parametrize("kind, buckets", [("sends", 1), ("checks", 2), ("sessions", 1)])
def test_keys_of_a_bucket_stay_apart(spark, tmp_path, kind, buckets):
    rng = random.Random(7)
    at = sorted(rng.randrange(700 if kind == "checks" else 9000) for _ in range(240))
    rows = [(rng.choice([None, *"abcdefghij"]), i, float(s), rng.choice([True, False, False, False, None])) for i, s in enumerate(at)]
    for part, some in enumerate((rows[:80], rows[80:160], rows[160:])):
        out = run(spark, tmp_path, some, kind, buckets, part)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("issued", F.lit(0.0)).withColumn("ok", F.coalesce("ok", F.lit(False)))
    if kind == "sends":
        same(machines.committed(spark, out).collect(), quota.otp_sends(batch, "who", "id", "sec").select("who", "id", "sent", "retry_after_s").collect())
    elif kind == "checks":
        same(machines.committed(spark, out).collect(), quota.otp_verify(batch, "who", "id", "sec", "ok", "issued").select("who", "id", "verdict").collect())
    else:
        want, last = {}, {}
        for who, _, sec, _ in rows:
            if who not in last or sec - last[who][1] >= 1800:
                last[who] = (sec, sec)
            last[who] = (last[who][0], sec)
            want[who, last[who][0]] = want.get((who, last[who][0]), 0) + 1
        got = twins.latest(spark, out, "key", "start_us").filter("n > 0").collect()
        same([(r.key, r.start_us / 1_000_000 - START, r.n) for r in got], [(who, start, n) for (who, start), n in want.items()])


@pytest.mark.parametrize("kind", MADE)
def test_states_follow_buckets_and_not_keys(spark, tmp_path, kind):
    run(spark, tmp_path, [(f"k{i}", i, float(i), False) for i in range(50)], kind, 1)
    assert spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "checkpoint")).count() == 1
