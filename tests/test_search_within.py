"""The search inside many small scopes: the same rows as the search of each scope, no index row for each scope, bounded arrays."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexloom import storage
from lexloom.operators import contracts, retrieve, scopes

SCHEMA = "scope string, item_id string, text string, embedding array<double>, category string"
COLUMNS = ["query_id", "scope", "item_id", "text", "category", "score", "rank", "threshold", "is_confident"]


def clauses(rng, sizes, odd=True):
    """Few words and coarse vectors, so that scores and distances tie; with ``odd`` ones, texts without words, and vectors that are missing, short, or hold nulls."""
    rows = []
    for s, n in enumerate(sizes):
        for k in rng.sample(range(10 * n), n):
            text = rng.choice(["", None, "...", "one"]) if odd and rng.random() < 0.15 else " ".join(rng.choices(["Fee", "pay", "term", "notice", "law", "ende", "x1"], k=rng.randint(1, 9)))
            vector = [float(rng.randint(0, 2)) for _ in range(3)]
            if odd and rng.random() < 0.2:
                vector = rng.choice([None, vector[:2], [None, 1.0, 0.0], [None, None, None]])
            rows.append((f"s{s}", f"i{k}", text, vector, rng.choice(["Termination", "Payment", None])))
    return rows


def both(spark, rows, share=0.7):
    rng = random.Random(len(rows))
    items = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([r[:2] for r in rows if r[0] is not None and rng.random() < share] + [("s0", "none"), ("none", "i1")], "scope string, item_id string")
    queries = items.join(asked, ["scope", "item_id"], "left_semi").select(F.col("item_id").alias("query_id"), "scope", "text", "embedding")
    found = retrieve.search_within(items, asked)
    assert set(found.columns) == set(COLUMNS)
    pick = lambda df: sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)
    return pick(found), pick(retrieve.search(queries, items))


@pytest.mark.parametrize("odd", [False, True])
def test_same_as_search(odd, spark):
    rng = random.Random(11)
    rows = clauses(rng, [1, 2, 3, 5, 8, 30, 45, 1, 0, 30], odd) + [(None, "lost", "pay", [1.0, 0.0, 0.0], None)]
    got, want = both(spark, rows)
    assert got == want and len({r[1] for r in got}) == 9


def test_large_scopes_and_small_arrays(spark, monkeypatch):
    """Scopes beyond the limit take the general way; cells and steps do not change results."""
    rows = clauses(random.Random(12), [4, 25, 7, 40, 9])
    whole, want = both(spark, rows)
    monkeypatch.setattr(scopes, "SMALL", 10)
    monkeypatch.setattr(scopes, "AT_ONCE", 50)
    cut, _ = both(spark, rows)
    assert whole == want == cut
    items, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([r[:2] for r in rows], "scope string, item_id string")
    pick = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert pick(scopes.search(items, asked, len(rows), cell_items=3)) == pick(scopes.search(items, asked, len(rows)))


def test_nothing_to_search(spark):
    items = spark.createDataFrame([], SCHEMA)
    assert retrieve.search_within(items, items.select("scope", "item_id")).collect() == []
    one = spark.createDataFrame([("s", "a", "pay", [1.0], None)], SCHEMA)
    assert retrieve.search_within(one, one.select("scope", "item_id").limit(0)).collect() == []


def test_grounding_writes_no_row_a_scope(spark, sf_dir, monkeypatch):
    """An index row, a chunk and a ranking for each small scope were most of the time."""
    tags, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, tag, *more: (tags.append(tag), stored(df, tag, *more))[1])
    assert __spark_entry__.queries()["grounding"](spark, sf_dir).count() > 0
    assert tags == []


def test_only_flagged_clauses_ask(spark):
    rows = [("c", 1, "pay the fee", [1.0], None), ("c", 2, "pay", [0.5], None), ("d", 3, "pay", [0.5], None)]
    items = spark.createDataFrame(rows, "scope string, item_id int, text string, embedding array<float>, category string")
    found = contracts.grounding(items, items, spark.createDataFrame([(1, "low"), (2, "medium"), (3, "high")], "item_id int, severity string"))
    assert sorted((r.query_id, r.scope, r.item_id, r["rank"]) for r in found.collect()) == [(2, "c", 1, 1), (2, "c", 2, 2), (3, "d", 3, 1)]
