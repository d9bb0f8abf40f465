"""Joins that deal hot keys apart, and the shared store."""

import os

import pytest
from pyspark.sql import functions as F

from lexloom import storage
from lexloom.llm import store


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 911 + 100)  # one key has a third
    return spark.range(30_000).select(key.alias("token"), (F.col("id") * 31).alias("sid")).unionByName(spark.range(500).select((F.col("id") + 10_000).alias("token"), F.col("id").alias("sid")))


@pytest.mark.parametrize("sample", [1 << 20, 3000])
def test_hot_join(spark, rows, monkeypatch, sample):
    monkeypatch.setattr(store, "SAMPLE", sample)
    keys = store.hot_keys(rows, ["token"], "sid")
    hot = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    assert hot in keys and len(keys) < store.HOT_KEYS
    right = rows.groupBy("token").agg(F.max("sid").alias("top")).filter("token % 2 = 1")
    got = store.hot_join(rows, right, ["token"], "sid")
    want = rows.join(right, "token")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert store.hot_join(rows.limit(0), right, ["token"], "sid").count() == 0


@pytest.mark.parametrize("sample", [1 << 20, 3000])
def test_shared_tokens(rows, monkeypatch, sample):
    monkeypatch.setattr(store, "SAMPLE", sample)
    got = {(r.token, r.sid): r.n for r in store.shared_tokens(rows, "sid").collect()}
    counts = {}
    for r in rows.collect():
        counts.setdefault(r.token, []).append(r.sid)
    assert set(got) == {(t, s) for t, sids in counts.items() if len(sids) > 1 for s in sids}
    assert all(n == len(counts[t]) or n == (1 << 63) - 1 for (t, _), n in got.items()) and got[7, 0] == (1 << 63) - 1


def test_sweep_deletes_what_is_not_kept(spark):
    start = storage.mark()
    one, two = (storage.stored(spark.range(n), f"t{n}") for n in (1, 2))
    at = [t.stored_at.removeprefix("file://") for t in (one, two)]
    storage.sweep(spark, start, two)
    assert [os.path.exists(p) for p in at] == [False, True] and two.count() == 2
    storage.sweep(spark, start)
    assert not os.path.exists(at[1])


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)
    Cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        storage.shared_dir(Cluster)
