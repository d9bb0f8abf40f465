"""Global order in blocks: sums before a row, splits of groups, and deficits by sizes."""

import random
import re

from pyspark.sql import functions as F

from lexloom.operators import datasets, prefix, quota


def singles(df):
    """Rows that a plan brings into one partition, by the node that asks for it."""
    return re.findall(r"Exchange SinglePartition.*\n.*", df._jdf.queryExecution().executedPlan().toString())


def test_sums_before(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0, 1, 5, None])) for k in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v int")
    want, spent = {}, 0
    for k, v in sorted(rows):
        want[k] = spent
        spent += v or 0
    for block in (None, F.expr("k div 37")):
        got = prefix.sums_before(df, ["k"], F.col("v"), "spent", block)
        assert {r.k: r.spent for r in got.collect()} == want
    assert {r.k: r.spent for r in quota.budget_stop(df, "k", "v", 100).collect()} == {k: s for k, s in want.items() if s < 100}
    assert quota.budget_stop(df.limit(0), "k", "v", 100).collect() == []


def greedy(groups, shares):
    total, have, out = float(sum(n for _, n in groups)), [0.0] * len(shares), {}
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        gaps = [round(s * total - h, 6) for s, h in zip(shares, have)]
        i = gaps.index(max(gaps))
        have[i] += n
        out[g] = i
    return out


def test_deficits_equal_the_greedy_rule(spark):
    rng = random.Random(7)
    for sizes, shares in [([1], [0.7, 0.15, 0.15]), ([1, 2, 3, 50], [0.5, 0.5]), ([0, 4, 9], [0.2, 0.3, 0.4, 0.1]), (range(1, 90), [0.7, 0.15, 0.15]), ([3, 3, 1000], [0.9, 0.1])]:
        groups = [(f"g{k:04d}", rng.choice(list(sizes))) for k in range(400)]
        df = spark.createDataFrame(groups, "g string, n long")
        names = [f"s{i}" for i in range(len(shares))]
        got = {r.g: int(r.split[1:]) for r in datasets.deficit_assign(df, "g", "n", dict(zip(names, shares))).collect()}
        assert got == greedy(groups, shares)
    assert datasets.deficit_assign(df.limit(0), "g", "n", {"a": 0.5, "b": 0.5}).collect() == []


def test_no_row_meets_all_others(spark):
    """Only blocks and totals come into one partition: what is exchanged there carries no group."""
    df = spark.range(1000).select(F.col("id").cast("string").alias("grp"), F.col("id").alias("n"))
    for plan in (datasets.group_split(df, "grp"), quota.budget_stop(df, "grp", "n", 100)):
        below = singles(plan)
        assert below and all("HashAggregate" in b for b in below), below
