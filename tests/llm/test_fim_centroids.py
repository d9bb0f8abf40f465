"""Fill-in-middle by round trips and by its definition; centroids against plain rounds."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import centroids, fim

TEXTS = ["", None, "a", "plain words", "two\nlines\r\n\x0b end", "has <S> inside", "<P", "S>", "é𝄞́x", "<<<>>>", "x" * 30000, "  \x85"]


def by_definition(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_arranged_as_defined_and_restored(spark):
    rows = [(i, t, "x") for i in [*range(40), None] for t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, units string").repartition(3)
    found = fim.arrange(df).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == by_definition(r.row.doc_id, r.row.text)
        assert r.back == (r.row.text or "") and r.row.units == "x"
    assert fim.arrange(df.limit(0)).count() == 0


def test_other_units(spark):
    """Words with the blanks after them cover a text; words alone do not, so such a text stays as it is."""
    df = spark.createDataFrame([(i, "some words in  a row, \n and more") for i in range(30)], "doc_id long, text string")
    whole = fim.arrange(df, pattern=r"\s*\S+\s*").withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.row.text and r.n == 7 for r in whole) and any(r.form != "plain" for r in whole)
    assert {r.form for r in fim.arrange(df, pattern=r"\S+").collect()} == {"plain"}


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = fim.op11_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def plain_rounds(rows, dims, k, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), at


@pytest.mark.parametrize("k", [1, 3, 7, 300])
def test_same_as_plain_rounds(spark, k):
    """A coarse grid makes ties, equal vectors and equal centroids."""
    rng = np.random.default_rng(k)
    rows = [(int(i) if i else None, [float(x) for x in rng.integers(-2, 3, 4) / 256.0]) for i in rng.integers(0, 60, 150)]
    rows += [(7, [0.5, -0.25, 3.0, 1e-9])] * 20 + [(1, None), (2, []), (3, [1.0] * 5), (4, [None, 1.0, 1.0, 1.0]), (5, [math.nan] * 4), (6, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, own string").repartition(3)
    found, at = centroids.cluster(df, dims=4, clusters=k)
    want, centres = plain_rounds(rows, 4, k)
    got = found.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert at.tolist() == centres
    spread = {}
    for r in got:
        spread[r.cluster] = spread.get(r.cluster, 0) + r.distance
    assert all(r.cluster_inertia == spread[r.cluster] and r.inertia == sum(spread.values()) for r in got)


def test_odd_tables(spark):
    schema = "vec_id string, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema))[0].count() == 0
    huge = spark.createDataFrame([("a", [3e38] * 64), ("b", [-3e38] * 64), (None, [0.0] * 64)], schema)
    assert {(r.vec_id, r.distance) for r in centroids.cluster(huge)[0].collect()} == {("a", 0), ("b", 0), (None, 0)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 4))
def test_bounds_skip_no_nearer_centroid(seed, k, scale):
    rng = np.random.default_rng(seed)
    x = rng.integers(-(3**scale), 3**scale + 1, (80, 3)).astype(np.int64)
    at, before, state, asked, full = x[rng.integers(0, 80, k)], None, (None, None, None), 0, 0
    for _ in range(5):
        own, upper, lower, n = centroids.assign(x, *state, centroids.Centroids(at, before))
        squared = ((x[:, None, :] - at[None]) ** 2).sum(2)
        assert (own == squared.argmin(1)).all()
        roots = np.sqrt(squared.astype(np.longdouble))
        assert (upper >= roots[np.arange(80), own]).all() and (lower <= roots).all()
        state, before, asked, full = (own, upper, lower), at, asked + n, full + 80 * k
        at = at + rng.integers(-1, 2, at.shape)
    assert asked <= full
