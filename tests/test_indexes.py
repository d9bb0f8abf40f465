"""Lexical and vector indexes against plain definitions; versioned tables under readers, dead writers and rivals; islands against one pass."""

import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lexloom import storage
from lexloom.operators import assess, lexical, nearest, quota, retrieve
from lexloom.sources.snapshots import Conflict, Snapshots


def plain_bm25(items, queries, k, zeros=False):
    """Every query against every item of its scope, by the formula."""
    out = []
    words = {i: re.findall(r"\w+", (t or "").lower()) for _, i, t in items}
    for scope in {s for s, _, _ in items}:
        own = [i for s, i, _ in items if s == scope]
        df = {}
        for i in own:
            for t in set(words[i]):
                df[t] = df.get(t, 0) + 1
        raw = {t: math.log(len(own) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0.0
        mean = sum(len(words[i]) for i in own) / len(own)
        for q, s, text in queries:
            if s != scope:
                continue
            asked, scores = re.findall(r"\w+", (text or "").lower()), []
            for i in own:
                gains = [((raw[t] if raw[t] >= 0 else floor) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(words[i]) / mean))) for t in asked if (c := words[i].count(t))]
                if gains or zeros:
                    scores.append((-round(sum(gains), 6), i))
            out += [(q, scope, i, -v, r + 1) for r, (v, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("zeros", [False, True])
def test_bm25_in_own_scope(spark, zeros, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    monkeypatch.setattr(lexical, "CHUNK", 4)
    random.seed(3)
    say = lambda n: " ".join(random.choice("alpha beta Gamma delta eps the the the".split()) for _ in range(n))
    items = [("hot" if k % 3 == 0 else f"s{k % 17}", k, say(random.randint(0, 12)) if k % 19 else None) for k in range(300)]
    queries = [(k, "hot" if k % 2 else f"s{k % 19}", say(random.randint(0, 5)) + (" unknown" if k % 5 == 0 else "")) for k in range(60)]
    df = spark.createDataFrame(items, "scope string, item_id long, text string").repartition(5)
    blocks = storage.stored(lexical.build(df), "test-blocks")
    found = lexical.search(spark.createDataFrame(queries, "query_id int, scope string, text string"), blocks, 5, zero_scores=zeros)
    want = plain_bm25(items, queries, 5, zeros)
    got = sorted((r.query_id, r.scope, r.item_id, r.score, r["rank"]) for r in found.collect())
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    assert all(math.isclose(g[3], w[3], abs_tol=2e-6) for g, w in zip(sorted(got, key=lambda r: (r[0], r[4])), sorted(want, key=lambda r: (r[0], r[4]))))


def test_bm25_joins_by_scope(spark):
    """Queries and blocks meet on the scope, and nowhere else."""
    items = spark.createDataFrame([(k % 50, k, f"word{k % 3} text") for k in range(500)], "scope int, item_id int, text string")
    blocks = storage.stored(lexical.build(items), "test-blocks")
    found = lexical.search(items.select("scope", F.col("item_id").alias("query_id"), "text"), blocks, None)
    assert found.filter(F.col("query_id") % 50 != F.col("item_id") % 50).count() == 0
    assert found.count() == 500 * 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_index(spark):
    items = spark.createDataFrame([], "scope string, item_id int, text string")
    q = spark.createDataFrame([(1, "a", "word")], "query_id int, scope string, text string")
    assert retrieve.bm25(q, items).count() == 0
    silent = spark.createDataFrame([("a", 1, None), ("a", 2, "")], items.schema)
    assert retrieve.bm25(q, silent).count() == 0
    assert retrieve.bm25(q, silent, zero_scores=True).count() == 2


def test_inverted_file(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    v = v.unionByName(spark.createDataFrame([(-1, None)], "item_id long, embedding array<float>"))
    q = v.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    path = storage.new_path(spark, "test-ivf")
    centres = nearest.build(v, path)
    exact = retrieve.knn(q.withColumn("scope", F.lit(1)), v.filter("embedding is not null").withColumn("scope", F.lit(1)), 5)
    found = nearest.search(spark, q, path, centres, nearest.calibrate(spark, path, centres, 5), 5)
    measured = nearest.recall(found, exact).first()
    assert measured.queries == q.count() and measured.recall >= 0.9
    every = nearest.search(spark, q, path, centres, len(centres), 5)
    rows = lambda df: sorted((r.query_id, r.item_id, r["rank"]) for r in df.collect())
    assert rows(every) == rows(exact)
    one = nearest.search(spark, q.limit(1), path, centres, 1, 5)
    assert "dynamicpruning" in one._jdf.queryExecution().executedPlan().toString().lower()
    assert nearest.recall(one, exact.join(q.limit(1).select("query_id"), "query_id")).first().queries == 1


@pytest.fixture
def snapshots(spark):
    s = Snapshots(spark, storage.new_path(spark, "test-snapshots"))
    s.create(spark.createDataFrame([(k % 10, k, f"v{k}") for k in range(100)] + [(None, -1, "n")], "k long, id long, v string"), ["k"], 4)
    return s


def ids(df):
    return sorted(r.id for r in df.collect())


def test_snapshot_readers_stay_on_their_version(spark, snapshots):
    before = snapshots.read()
    assert snapshots.replace(spark.createDataFrame([(3, 1000, "new"), (77, 1001, "other"), (None, -2, "n")], "k long, id long, v string")) == 2
    assert ids(before) == [-1, *range(100)]
    after = sorted([k for k in range(100) if k % 10 != 3] + [1000, 1001, -2])
    assert ids(snapshots.read()) == after and ids(snapshots.read(1)) == [-1, *range(100)]
    assert ids(snapshots.read(key={"k": 3})) == [1000] and ids(snapshots.read(1, {"k": 3})) == list(range(3, 100, 10))
    assert snapshots.delete(spark.createDataFrame([(77,), (None,), (5,)], "k long")) == 3
    assert ids(snapshots.read()) == sorted(k for k in after if k not in (1001, -2) and k % 10 != 5)
    assert snapshots.delete(spark.createDataFrame([], "k long")) == 3


def test_snapshot_untouched_buckets_are_not_rewritten(spark, snapshots):
    first = snapshots.manifest()["holds"]
    snapshots.replace(spark.createDataFrame([(3, 1000, "new")], "k long, id long, v string"))
    second = snapshots.manifest()["holds"]
    assert sum(first[b] != second[b] for b in first) == 1


def test_snapshot_writer_that_dies(spark, snapshots, monkeypatch):
    """Its files are there, but no version names them; the next vacuum deletes them."""
    monkeypatch.setattr(Snapshots, "_commit", lambda self, manifest: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        snapshots.replace(spark.createDataFrame([(3, 1000, "new")], "k long, id long, v string"))
    monkeypatch.undo()
    assert snapshots.versions() == [1] and ids(snapshots.read()) == [-1, *range(100)]
    assert len(snapshots.vacuum()) == 1 and ids(snapshots.read()) == [-1, *range(100)]


def test_snapshot_rivals(spark, snapshots):
    """Of two changes that start from one version the second finds its number taken."""
    row = lambda n: spark.createDataFrame([(3, n, "new")], "k long, id long, v string")
    assert snapshots.replace(row(1), base=1) == 2
    with pytest.raises(Conflict):
        snapshots.replace(row(2), base=1)
    assert ids(snapshots.read(key={"k": 3})) == [1]
    with pytest.raises(LookupError):
        snapshots.read(9)
    with pytest.raises(LookupError):
        Snapshots(spark, f"/tmp/none-{uuid.uuid4().hex}").read()


def test_used_up_retries_open_no_breaker(spark):
    calls = [("busy", n, 503, None) for n in (1, 2, 3)] + [("slow", n, 429, "5") for n in (1, 2, 3)] + [("long", 1, 429, "90"), ("fine", 1, 200, None), ("bad", 1, 400, None)]
    done = assess.reduce_calls(spark.createDataFrame(calls, "id string, n int, code int, retry_after string"), "id")
    assert {r.id: r.outcome for r in done.collect()} == {"busy": "failed", "slow": "failed", "long": "exhausted", "fine": "ok", "bad": "failed"}


def test_codes_end_at_their_expiry(spark):
    tries = [(1, 1, 599.0, True), (2, 2, 600.0, True), (3, 3, 599.5, False), (3, 4, 600.0, True), (3, 5, 601.0, True)] + [(4, 10 + n, float(n), False) for n in range(6)]
    df = spark.createDataFrame(tries, "code int, i int, at double, ok boolean").withColumn("issued", F.lit(0.0))
    got = {r.i: r.verdict for r in quota.otp_verify(df, "code", "i", "at", "ok", "issued").collect()}
    assert got == {1: "verified", 2: "expired", 3: "wrong", 4: "expired", 5: "cleared", 10: "wrong", 11: "wrong", 12: "wrong", 13: "wrong", 14: "locked", 15: "cleared"}


def test_islands_change_nothing(spark):
    """Sparse and dense stretches of one key: the same starts as in one island, and more than one island."""
    random.seed(8)
    rows, at = [], 0.0
    for k in range(400):
        at += random.choice([0, 1, 5, 30, 700]) if k % 50 else 3000
        rows.append((1, k, at, random.randint(100, 7000)))
    df = spark.createDataFrame(rows, "p int, i int, at double, n int")
    got = {r.i: r.start_s for r in quota.token_pace(df, "p", "i", "at", "n").collect()}
    started = []
    for _, k, arrival, n in rows:
        free = max([arrival, *(s + 21 for s, _ in started[-1:])])
        ready = max([arrival, *(s for s, _ in started[-1:])])
        held = [(s, m) for s, m in started if s > ready - 60]
        start = max(free, held[0][0] + 60) if held and sum(m for _, m in held) + n > 10_000 else free
        assert got[k] == start
        started.append((start, n))
    sends = {r.i: (r.sent, r.retry_after_s) for r in quota.otp_sends(df, "p", "i", "at").collect()}
    first = last = None
    used = 0
    for _, k, t, _ in rows:
        if last is not None and t - last < 60:
            assert sends[k] == (False, int(60 - (t - last)) + 1)
        elif first is not None and t - first < 900 and used >= 5:
            assert sends[k] == (False, int(900 - (t - first)) + 1)
        else:
            first, used = (t, 1) if first is None or t - first >= 900 else (first, used + 1)
            last = t
            assert sends[k] == (True, None)
