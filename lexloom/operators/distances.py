"""Exact nearest vectors in cells: bounded blocks of items meet bounded chunks of queries, in matrix products.

* A scope falls into one of as many cells as there are blocks of items. A cell with more than ``BLOCK`` items or ``CHUNK`` queries is a grid of
  parts, dealt by hashes of the ids, so one large scope is many tasks and many small scopes are one. A task holds one block and one chunk.
* Products give distances up to their rounding error. All items that could be among a query's best ``k`` within that error are
  computed again as the plain sum over components in their order, rounded, and cut to ``k`` by distance and id.
* Of equal vectors of a block only the ``k`` of smallest ids take part; the others cannot be among the best ``k``.

Components that are null on either side are left out of the sum; without any component the distance is null and comes last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items and queries of a task, and distances that are held at once.
BLOCK, CHUNK, AT_ONCE = 8192, 8192, 1 << 21


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """[row, component] and which components there are."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.asarray(pc.fill_null(lists.value_lengths(), 0)).astype(np.int64)
    flat = lists.flatten().cast(pa.float64())
    values, there = flat.to_numpy(zero_copy_only=False), np.asarray(flat.is_valid())
    if (lengths == width).all():
        return values.reshape(-1, width), there.reshape(-1, width)
    x, has = np.full((len(lengths), width), np.nan), np.zeros((len(lengths), width), bool)
    row, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x[row, place], has[row, place] = values, there
    return x, has


def _rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero."""
    scaled = d * 10.0**digits
    below = np.floor(scaled)
    out = (below + (scaled - below >= 0.5)) / 10.0**digits
    return np.where(np.isfinite(out), out, d)


class _Cell:
    """The best ``k`` of each query among the items seen so far."""

    def __init__(self, q: tuple, x: tuple, ids: np.ndarray, k: int, digits: int):
        (self.q, self.q_has), (self.x, self.x_has), self.ids, self.k, self.digits = q, x, ids, k, digits
        self.plain_q, self.plain_x = (h.all(axis=1) & (np.abs(m) < 1e100).all(axis=1) for m, h in (q, x))
        self.norms = (self.x**2).sum(axis=1)
        self.pending, self.waiting = [], 0
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))

    def add(self, q: np.ndarray, x: np.ndarray) -> None:
        """Pairs to be decided."""
        self.pending.append((q, x))
        self.waiting += len(q)
        if self.waiting >= AT_ONCE:
            self.decide()

    def add_all(self, q: np.ndarray, x: np.ndarray) -> None:
        """All pairs of some queries and some items."""
        step = max(1, AT_ONCE // max(1, len(x)))
        for at in range(0, len(q) if len(x) else 0, step):
            some = q[at : at + step]
            self.add(np.repeat(some, len(x)), np.tile(x, len(some)))

    def decide(self) -> None:
        if not self.pending:
            return
        q, x = (np.concatenate(c) for c in zip(*self.pending))
        self.pending, self.waiting = [], 0
        d, none = np.empty(len(q)), np.zeros(len(q), bool)
        step = 1 << 16
        for at in range(0, len(q), step):
            i, j = q[at : at + step], x[at : at + step]
            parts = (self.q[i] - self.x[j]) ** 2
            if not (self.plain_q[i].all() and self.plain_x[j].all()):
                both = self.q_has[i] & self.x_has[j]
                parts[~both] = 0.0
                none[at : at + step] = ~both.any(axis=1)
            d[at : at + step] = np.cumsum(parts, axis=1)[:, -1] if parts.shape[1] else 0.0
        q, x, d, none = (np.concatenate(c) for c in zip(self.best, (q, x, _rounded(d, self.digits), none)))
        order = np.lexsort((self.ids[x], d, none, q))
        q, x, d, none = q[order], x[order], d[order], none[order]
        starts = np.nonzero(np.concatenate([[True], q[1:] != q[:-1]]))[0]
        kept = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < self.k
        self.best = q[kept], x[kept], d[kept], none[kept]

    def _without_copies(self, x: np.ndarray) -> np.ndarray:
        """The first ``k`` by id of each vector; ``x`` is in order of ids."""
        rows = np.ascontiguousarray(self.x[x])
        _, of = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(of.max() + 1))
        kept = np.arange(len(x)) - starts[of[order]] < self.k
        return x[np.sort(order[kept])]

    def meet(self, q: np.ndarray, x: np.ndarray) -> None:
        """Queries and items of one scope."""
        if len(x) <= 4 * self.k or len(q) * len(x) <= 4096 or not self.x.shape[1]:
            return self.add_all(q, x)
        self.add_all(q[~self.plain_q[q]], x)
        q = q[self.plain_q[q]]
        self.add_all(q, x[~self.plain_x[x]])
        x = x[self.plain_x[x]]
        if len(x) and len(q):
            x = self._without_copies(x)
            rows, norms = self.x[x], self.norms[x]
            place = min(self.k, len(x)) - 1
            step = max(1, AT_ONCE // len(x))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                mine = self.q[some]
                far = norms[None, :] - 2 * mine @ rows.T
                error = 1e-12 * ((mine**2).sum(axis=1) + norms.max()) + 1.5 * 10.0**-self.digits
                i, j = np.nonzero(far <= (np.partition(far, place, axis=1)[:, place] + error)[:, None])
                self.add(some[i], x[j])


def _kinds(df: DataFrame, *names: str) -> list[str]:
    return [df.schema[n].dataType.simpleString() for n in names]


def nearest(queries: DataFrame, items: DataFrame, k: int, digits: int = 6, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, scope, item_id, distance) of (query_id, scopes, embedding) against (scope, item_id, embedding): the best ``k`` a query and task or more, to be ranked.

    ``scopes`` is an array: a query meets the items of each of them.
    """
    cells = max(1, -(-items.count() // block))
    cell = lambda scope: F.pmod(F.xxhash64(scope), F.lit(cells))
    x = items.filter(F.col("scope").isNotNull()).select("scope", "item_id", "embedding", cell(F.col("scope")).alias("cell"))
    q = queries.withColumn("cell", F.explode(F.array_distinct(F.transform("scopes", cell))))
    q = q.select("query_id", "embedding", "cell", F.filter("scopes", lambda s: cell(s) == F.col("cell")).alias("scopes"))
    parts = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    grid = F.broadcast(parts(x, block, "xs").join(parts(q, chunk, "qs"), "cell"))  # one row a cell at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = x.join(grid, "cell").select("cell", F.pmod(F.xxhash64("item_id"), F.col("xs")).cast("int").alias("xp"), every("qs").alias("qp"), "scope", "item_id", "embedding")
    q = q.join(grid, "cell").select("cell", every("xs").alias("xp"), F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int").alias("qp"), F.col("query_id").alias("query_id"), "scopes", F.col("embedding").alias("asked"))
    (query_kind,), (scope_kind, item_kind) = _kinds(queries, "query_id"), _kinds(items, "scope", "item_id")

    def run(right: pa.Table, left: pa.Table) -> pa.Table:
        right = right.sort_by([("scope", "ascending"), ("item_id", "ascending")]).combine_chunks()
        left = left.combine_chunks()
        vectors = left.column("asked"), right.column("embedding")
        width = max(pc.max(pc.list_value_length(v)).as_py() or 0 for v in vectors)
        ids = np.empty(len(right), np.int64)
        ids[np.asarray(pc.sort_indices(right.column("item_id")))] = np.arange(len(right))
        found = _Cell(*(_matrix(v, width) for v in vectors), ids, k, digits)
        names = pc.unique(right.column("scope"))
        of = np.asarray(pc.index_in(right.column("scope"), value_set=names))
        ends = np.searchsorted(of, np.arange(len(names) + 1))
        scopes = left.column("scopes")
        row, asks = np.asarray(pc.list_parent_indices(scopes)), np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(scopes), value_set=names), -1))
        order = np.argsort(asks, kind="stable")
        firsts = np.searchsorted(asks[order], np.arange(len(names) + 1))
        for s in range(len(names)):
            mine = row[order[firsts[s] : firsts[s + 1]]]
            if len(mine):
                found.meet(mine, np.arange(ends[s], ends[s + 1]))
        found.decide()
        i, j, d, none = found.best
        best = right.take(pa.array(j))
        return pa.table({"query_id": left.column("query_id").take(pa.array(i)), "scope": best.column("scope"), "item_id": best.column("item_id"), "distance": pa.array(d, mask=none)})

    schema = f"query_id {query_kind}, scope {scope_kind}, item_id {item_kind}, distance double"
    keys = ("cell", "xp", "qp")
    return x.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, schema)
