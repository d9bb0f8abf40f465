"""Percentiles of keys of any size against nearest rank."""

import random

from lexloom.operators import observe

COLUMNS = ["n", "min", "max", "p50", "p95"]


def rows_of(df, *keys):
    return sorted(((*(r[k] for k in keys), *(r[c] for c in COLUMNS)) for r in df.collect()), key=repr)


def test_selected_equals_nearest_rank(spark):
    rng = random.Random(8)
    rows = [("big", rng.lognormvariate(0, 3)) for _ in range(5000)] + [("ties", float(rng.randrange(3))) for _ in range(900)]
    rows += [("one", 7.0), ("two", 1.0), ("two", 2.0), ("nulls", None), (None, 4.0), (None, None), ("same", 5.0), ("same", 5.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    for part, keys in ((df, ("key",)), (df, ()), (df.limit(0), ("key",)), (df.filter("v > 1e300"), ())):
        assert rows_of(observe.selected_percentiles(part, "v", *keys), *keys) == rows_of(observe.percentiles(part, "v", *keys), *keys)


def test_a_wrong_bracket_is_computed_again(spark):
    """Sketches of the least size with no margin are often wrong; the results are not."""
    rng = random.Random(9)
    df = spark.createDataFrame([(k % 20, rng.random()) for k in range(20_000)], "key long, v double")
    assert rows_of(observe.selected_percentiles(df, "v", "key", k=8, margin=0.0), "key") == rows_of(observe.percentiles(df, "v", "key"), "key")


def test_merged_sketches(spark):
    rng = random.Random(10)
    values = [rng.lognormvariate(0, 2) for _ in range(20_000)]
    df = spark.createDataFrame([(k % 7, v) for k, v in enumerate(values)], "part long, v double")
    got = observe.merged_percentiles(observe.sketched(df, "v", "part")).first()
    assert got.n == len(values)
    for p, at in ((0.5, got.p50), (0.95, got.p95)):
        assert abs(sum(v <= at for v in values) / len(values) - p) < 0.01
