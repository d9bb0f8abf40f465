"""Centroid clustering of integer vectors with Elkan's bounds; assignments and distances are exact.

Vectors are kept as blocks: one row holds some thousands of them as packed arrays, with the state that Elkan's method
caches for each vector: its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to every centroid.
A round is one pass: it moves the bounds by how far the centroids went, skips what the bounds exclude, measures
the rest in integers, and stores the blocks again with their cluster sums; the sums (a number a component, cluster and task) give the next centroids.

* Bounds are kept in 32-bit floats. Upper bounds and movements are rounded up, lower bounds and halves of
  inter-centroid distances down, so that rounding can only cause a measurement, never prevent one.
* A centroid is skipped only where a bound is strictly greater; equal distances are measured, and the smaller number wins.

Everything but the blocks is of the size clusters x components and goes to the driver: the first centroids, the sums, the centroids.

Cases: vectors with another number of components, or with a null, infinite or undefined one, are left out; components
beyond +-2^26 after scaling count as +-2^26 (a distance would not fit 63 bits); fewer vectors than clusters give as many clusters as there are vectors;
none give an empty table; repeated rows are vectors of their own; where hashes tie (repeated or null ids; a null id hashes as
the empty string) the smaller components come first; equal centroids are told apart by their number; a sum of distances beyond 63 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Vectors of a block at most.
BLOCK = 8192
LIMIT = 1 << 26

_UP, _DOWN = np.float32(np.inf), np.float32(0)
_STATE = "own binary, upper binary, lower binary, sums binary, counts binary, spread binary"


def _up(x: np.ndarray) -> np.ndarray:
    """To 32 bits, rounded up; the square root before it may be off by one step of 64 bits, which two steps of 32 cover."""
    return np.nextafter(np.nextafter(x.astype(np.float32), _UP), _UP)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x.astype(np.float32), -_UP), -_UP), _DOWN)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of 64-bit integers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids of a round, and what bounds ask of them."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        between = np.stack([_squared(at, np.broadcast_to(c, at.shape)) for c in at]) if k else np.zeros((0, 0), np.int64)
        self.half = _down(np.sqrt(between.astype(np.float64)) / 2)
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest_half = apart.min(axis=1) if k else np.zeros(0, np.float32)
        self.moved = None if before is None else _up(np.sqrt(_squared(at, before).astype(np.float64)))


def assign(x: np.ndarray, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its bounds, and how many distances were measured. Without state: all distances."""
    n, k = len(x), len(c.at)
    if own is None:
        squared = np.stack([_squared(x, np.broadcast_to(v, x.shape)) for v in c.at], axis=1)
        own = squared.argmin(axis=1).astype(np.int32)
        roots = np.sqrt(squared.astype(np.float64))
        return own, _up(roots[np.arange(n), own]), _down(roots), n * k
    own, measured = own.copy(), 0
    upper = _up(upper.astype(np.float64) + c.moved[own])
    lower = _down(lower.astype(np.float64) - c.moved[None, :])
    rows = np.nonzero(~(upper < c.nearest_half[own]))[0]
    if not len(rows):
        return own, upper, lower, measured
    # the distance to the own centroid makes the upper bound tight, which excludes most of what is left
    best = _squared(x[rows], c.at[own[rows]])
    measured += len(rows)
    roots = np.sqrt(best.astype(np.float64))
    upper[rows], lower[rows, own[rows]] = _up(roots), _down(roots)
    for j in range(k):
        mine = own[rows]
        ask = np.nonzero((mine != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < c.half[mine, j]))[0]
        if not len(ask):
            continue
        at = rows[ask]
        found = _squared(x[at], np.broadcast_to(c.at[j], (len(at), x.shape[1])))
        measured += len(at)
        roots = np.sqrt(found.astype(np.float64))
        lower[at, j] = _down(roots)
        better = (found < best[ask]) | ((found == best[ask]) & (j < mine[ask]))
        own[at[better]], upper[at[better]], best[ask[better]] = j, _up(roots[better]), found[better]
    return own, upper, lower, measured


def _array(column: pa.Array, dtype, width: int) -> list[np.ndarray]:
    return [None if v is None else np.frombuffer(v, dtype).reshape(-1, width) for v in column.to_pylist()]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    """(ids, vectors): the vectors that count, as scaled integers."""
    for batch in batches:
        column = batch.column("v")
        lists = column.cast(pa.list_(pa.float64()))
        sizes = np.asarray(lists.value_lengths().fill_null(-1))
        good = np.nonzero(sizes == dims)[0]
        if not len(good):
            continue
        flat = lists.take(pa.array(good)).flatten()
        values = np.asarray(flat.fill_null(np.nan)).reshape(-1, dims)
        finite = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(values[finite] * scale), -LIMIT, LIMIT).astype(np.int32)
        ids = batch.column("id").take(pa.array(good[finite]))
        for start in range(0, len(x), BLOCK):
            kept = ids.slice(start, BLOCK)
            packed = x[start : start + BLOCK]
            listed = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
            yield pa.RecordBatch.from_arrays([listed, pa.array([packed.tobytes()], pa.binary())], names=["ids", "x"])


def _first(blocks: DataFrame, dims: int, k: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hashes: each task gives its own k, the driver gets k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, tuple]] = []
        for batch in batches:
            for ids, x in zip(batch.column("ids"), _array(batch.column("x"), np.int32, dims)):
                names = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids.as_py()]
                limit = best[-1][0] if len(best) == k else "g"
                best = sorted(best + [(h, tuple(int(v) for v in x[i])) for i, h in enumerate(names) if h <= limit])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int32()))], names=["hash", "v"])

    rows = blocks.mapInArrow(run, "hash string, v array<int>").orderBy("hash", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), dims)


def _pass(blocks: DataFrame, dims: int, c: Centroids, ids: str) -> DataFrame:
    """The blocks with their new state. Assignments come from the bounds; sums, counts and distances are of the new assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(c.at)
        for batch in batches:
            state = zip(*(_array(batch.column(n), t, w) for n, t, w in (("x", np.int32, dims), ("own", np.int32, 1), ("upper", np.float32, 1), ("lower", np.float32, k))))
            for i, (x, own, upper, lower) in enumerate(state):
                wide = x.astype(np.int64)
                own, upper, lower, _ = assign(wide, None if own is None else own[:, 0], None if upper is None else upper[:, 0], lower, c)
                order = np.argsort(own, kind="stable")
                counts = np.bincount(own, minlength=k)
                sums = np.zeros((k, dims), np.int64)
                some = np.nonzero(counts)[0]
                sums[some] = np.add.reduceat(wide[order], (np.cumsum(counts) - counts)[some], axis=0)
                distance = _squared(wide, c.at[own])
                packed = [a.tobytes() for a in (own, upper, lower, sums, counts.astype(np.int64), distance)]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1), batch.column("x").slice(i, 1), *(pa.array([a], pa.binary()) for a in packed)], names=["ids", "x", *(s.split()[0] for s in _STATE.split(", "))])

    return blocks.mapInArrow(run, f"ids {ids}, x binary, {_STATE}")


def _totals(blocks: DataFrame, dims: int, k: int) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Counts, sums and distance sums of each cluster: a number a task for each, added in decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, spread = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for batch in batches:
            for s, n, d, own in zip(_array(batch.column("sums"), np.int64, dims), _array(batch.column("counts"), np.int64, 1), _array(batch.column("spread"), np.int64, 1), _array(batch.column("own"), np.int32, 1)):
                counts += n[:, 0]
                sums += s
                for j in range(k):
                    if n[j, 0]:
                        spread[j] += sum(d[own[:, 0] == j, 0].tolist()) if int(d.max()) > 1 << 45 else int(d[own[:, 0] == j, 0].sum())
        whole = [*(int(v) for v in counts), *spread, *(int(v) for v in sums.ravel())]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int32()), pa.array([str(v) for v in whole])], names=["place", "part"])

    rows = blocks.select("own", "sums", "counts", "spread").mapInArrow(run, "place int, part string")
    added = rows.groupBy("place").agg(F.sum(F.col("part").cast("decimal(24,0)")).alias("whole")).collect()  # k * (dims + 2) numbers
    whole = [int(v) for _, v in sorted(added)]
    return np.array(whole[:k], np.int64), [whole[2 * k + i * dims : 2 * k + (i + 1) * dims] for i in range(k)], whole[k : 2 * k]


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that counts, and the centroids."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    blocks = materialise(rows.mapInArrow(lambda it: _blocks(it, dims, scale), f"ids array<{kind}>, x binary"), "vectors", batch_rows=BLOCK)
    at, before = _first(blocks, dims, clusters, seed), None
    k = len(at)
    now = blocks.select("*", *(F.lit(None).cast("binary").alias(n.split()[0]) for n in _STATE.split(", ")))
    for turn in range(rounds + 1):
        now = materialise(_pass(now, dims, Centroids(at, before), f"array<{kind}>"), f"vectors-{turn}", batch_rows=4)
        if turn == rounds or not k:
            break
        counts, sums, _ = _totals(now, dims, k)
        before, at = at, np.array([[s // int(n) for s in own] if n else list(old) for n, own, old in zip(counts, sums, at)], np.int64)
    _, _, spread = _totals(now, dims, k) if k else (None, None, [])
    shas = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in at]
    fits = [s if s < 1 << 63 else None for s in spread]
    total = sum(spread) if sum(spread) < 1 << 63 else None
    about = spark.createDataFrame([(j, fits[j], total, shas[j]) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, distance in zip(batch.column("ids"), _array(batch.column("own"), np.int32, 1), _array(batch.column("spread"), np.int64, 1)):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(own[:, 0]), pa.array(distance[:, 0])], names=["id", "cluster", "distance"])

    out = now.select("ids", "own", "spread").mapInArrow(unpack, f"id {kind}, cluster int, distance long")
    return out.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), at


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings``."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
