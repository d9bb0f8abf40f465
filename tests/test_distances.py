"""Exact neighbours in cells against plain sums."""

import random

import pytest

from lexloom.operators import distances, retrieve


def plain(queries, items, k):
    out = []
    for q, scope, v in queries:
        found = []
        for s, i, w in items:
            if s == scope:
                parts = [(x - y) * (x - y) for x, y in zip(v or [], w or []) if x is not None and y is not None]
                found.append((not parts, round(sum(parts), 6), i) if parts else (True, None, i))
        found.sort(key=lambda f: (f[0], f[1] or 0.0, f[2]))
        out += [(q, scope, i, d, rank) for rank, (_, d, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, chunk", [(8192, 8192), (40, 16)])
def test_cells_lose_no_neighbour(spark, block, chunk):
    """Copies, nulls, short vectors, small scopes beside a large one, and parts of every cell."""
    rng = random.Random(1)
    vector = lambda: [float(rng.randrange(-8, 8)) / 4 for _ in range(3)]
    items = [("big", i, vector()) for i in range(700)] + [("big", 700 + i, [0.5, 0.25, 0.0]) for i in range(200)]
    items += [(f"s{i % 50}", 1000 + i, vector()) for i in range(200)] + [("big", 2000, [None, 0.5, 0.5]), ("big", 2001, None), ("odd", 2002, None), ("odd", 2003, [1.0]), ("odd", 2004, [None] * 3)]
    rng.shuffle(items)
    queries = [(i, s, v) for s, i, v in items if i % 5 == 0] + [(5000, "odd", [1.0, 2.0, 3.0]), (5001, "odd", None), (5002, "none", [1.0, 2.0, 3.0])]
    q = spark.createDataFrame(queries, "query_id long, scope string, embedding array<float>")
    x = spark.createDataFrame(items, "scope string, item_id long, embedding array<float>")
    got = retrieve.knn(q, x, 7, block=block, chunk=chunk).select("query_id", "scope", "item_id", "distance", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain(queries, items, 7)


def test_pairs_are_not_rows(spark):
    """A task gives ``k`` rows a query: pairs of queries and items are cells of a matrix."""
    x = spark.range(30_000).selectExpr("'all' AS scope", "id AS item_id", "array(id % 1000, id % 77) AS embedding")
    q = x.filter("item_id % 20 = 0").selectExpr("item_id AS query_id", "array(scope) AS scopes", "embedding")
    assert distances.nearest(q, x, 5).count() == 4 * 5 * 1500
