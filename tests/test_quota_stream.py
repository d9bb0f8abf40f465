"""The streaming quota over several triggers and a restart: counters of many users in one group."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import quota
from lexloom.streaming import twins

SCHEMA = "user_id long, event_id long, sec long"


@pytest.mark.parametrize("buckets", [1, 8])
def test_counters_go_on_over_a_restart(spark, tmp_path, buckets):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rng = random.Random(2)
    at = sorted(rng.randrange(1_000_000_000, 1_000_200_000) for _ in range(400))
    rows = [(rng.choice([None, *range(12)]), i, s) for i, s in enumerate(at)]
    for part, some in enumerate((rows[:150], rows[150:300], rows[300:])):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={part}")
        events = spark.readStream.schema(SCHEMA).parquet(f"{folder}/part=*").withColumn("ts", F.timestamp_seconds("sec"))
        twins.run_to_table(twins.stateful_quota(events.select("user_id", "event_id", "ts"), 3, buckets), out, checkpoint)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec"))
    want = quota.daily_quota(batch, limit=3).select("user_id", "event_id", "accepted").collect()
    got = spark.read.parquet(out).select("user_id", "event_id", "accepted").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_one_call_serves_many_users(spark, tmp_path):
    """Groups follow buckets and days, not users."""
    schema = "user_id long, event_id long, ts timestamp"
    spark.range(50).selectExpr("id AS user_id", "id AS event_id", "timestamp_seconds(1000000000) AS ts").write.parquet(str(tmp_path / "in"))
    twins.run_to_table(twins.stateful_quota(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3, 1), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.format("statestore").load(str(tmp_path / "checkpoint")).count() == 1
