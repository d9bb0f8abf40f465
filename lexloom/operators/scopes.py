"""The full search (``retrieve.search``) inside many small scopes at once: each marked item against the items of its own scope.

Scopes are dealt whole to cells of about ``CELL`` items, so vectors, words and ranks of thousands of scopes are arrays of one task, and an item is
shuffled once. Queries of scopes of one size are a matrix; at most ``AT_ONCE`` places or matches of postings are held at a time.
A scope of more than ``SMALL`` items is not for this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from .distances import _matrix

#: Items of a scope at most; items of a cell, about; places of a matrix; cells of a shuffle partition.
SMALL, CELL, AT_ONCE, CELLS = 1024, 8192, 1 << 18, 16


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, on both of its sides."""
    scaled = np.abs(x) * 10.0**digits
    below = np.floor(scaled)
    out = np.copysign((below + (scaled - below >= 0.5)) / 10.0**digits, x)
    return np.where(np.isfinite(out), out, x) + 0.0


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _places(order: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the columns that ``order`` sorts, row by row."""
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(1, order.shape[1] + 1), order.shape), axis=1)
    return out


class _Words:
    """Postings of a cell's items: (item, term of its scope, count), by item, and again by term."""

    def __init__(self, tokens: pa.ListArray, of: np.ndarray, sizes: np.ndarray):
        lengths = np.asarray(pc.fill_null(tokens.value_lengths(), 0)).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        many = max(1, len(coded.dictionary))
        keys, counts = np.unique(np.repeat(np.arange(len(of)), lengths) * many + np.asarray(coded.indices).astype(np.int64), return_counts=True)
        self.item = keys // many
        terms, self.term, self.df = np.unique(of[self.item] * many + keys % many, return_inverse=True, return_counts=True)
        scope = terms // many
        raw = np.log(sizes[scope] - self.df + 0.5) - np.log(self.df + 0.5)
        mean = np.bincount(scope, raw, len(sizes)) / np.maximum(np.bincount(scope, minlength=len(sizes)), 1)
        idf = np.where(raw < 0, fixed.BM25_EPSILON * mean[scope], raw)
        average = np.bincount(of, lengths, len(sizes)) / sizes
        share = np.divide(lengths, average[of], out=np.zeros(len(of)), where=average[of] > 0)
        norm = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * share)
        self.asks = counts * idf[self.term] * (fixed.BM25_K1 + 1)
        self.part = counts / (counts + norm[self.item])
        self.by_term = np.argsort(self.term, kind="stable")
        self.first = np.cumsum(self.df) - self.df
        self.starts = np.searchsorted(self.item, np.arange(len(of) + 1))
        self.distinct = np.diff(self.starts)
        self.work = np.diff(np.concatenate([[0], np.cumsum(self.df[self.term])])[self.starts])

    def meet(self, q: np.ndarray, base: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(shared distinct words, scores) of queries with the ``n`` items from ``base`` on."""
        sizes = self.distinct[q]
        mine, row = _ranges(self.starts[q], sizes), np.repeat(np.arange(len(q)), sizes)
        many = self.df[self.term[mine]]
        other = self.by_term[_ranges(self.first[self.term[mine]], many)]
        row = np.repeat(row, many)
        cell = row * n + self.item[other] - base[row]
        made = (np.bincount(cell, w, len(q) * n).reshape(len(q), n) for w in (None, np.repeat(self.asks[mine], many) * self.part[other]))
        return next(made), next(made)


def _order(q: np.ndarray, base: np.ndarray, n: int, vectors: list, digits: int) -> np.ndarray:
    """The items of each query by rounded distance and id; without any component on both sides last."""
    values, there, full = vectors
    x = base[:, None] + np.arange(n)
    d, none = np.zeros(x.shape), np.ones(x.shape, bool)
    for c in range(len(values)):
        part = values[c][q][:, None] - values[c][x]
        part *= part
        if not full:
            both = there[c][q][:, None] & there[c][x]
            part[~both] = 0.0
            none &= ~both
        d += part
    d = _rounded(d, digits)
    return np.argsort(d, axis=1, kind="stable") if full else np.lexsort((d, none), axis=1)


def _best(right: pa.Table, q: np.ndarray, of: np.ndarray, starts: np.ndarray, sizes: np.ndarray, top: int, pool: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, item, score, rank) as places in ``right``."""
    one = lambda name: pa.concat_arrays(right.column(name).chunks)
    words = _Words(one("tokens"), of, sizes)
    lists = one("embedding")
    values, there = (np.ascontiguousarray(m.T) for m in _matrix(right.column("embedding"), pc.max(pc.list_value_length(lists)).as_py() or 0))
    vectors = [values, there, bool(there.all())]
    named = np.asarray(right.column("item_id").is_valid())
    size = sizes[of[q]]
    for n in np.unique(size):
        asked = q[size == n]
        groups = (np.cumsum(words.work[asked] + n) - 1) // AT_ONCE
        for some in np.split(asked, np.nonzero(np.diff(groups))[0] + 1):
            base = starts[of[some]]
            near = _places(_order(some, base, n, vectors, digits))
            shared, score = words.meet(some, base, n)
            hit = shared > 0
            worded = _places(np.argsort(np.where(hit, -_rounded(score, digits), np.inf), axis=1, kind="stable"))
            both = [near <= pool, hit & (worded <= pool)]
            fused = sum(np.where(b, 1.0 / (fixed.RRF_K + r), 0.0) for b, r in zip(both, (near, worded)))
            kept = _places(np.argsort(np.where(both[0] | both[1], -_rounded(fused, 9), np.inf), axis=1, kind="stable")) <= pool
            kept &= (both[0] | both[1]) & named[base[:, None] + np.arange(n)]
            share = shared / np.maximum(words.distinct[some], 1)[:, None]
            again = _rounded(1 / (1 + np.exp(-(8.0 * share - 4.0))), digits)
            first = np.argsort(np.where(kept, -again, np.inf), axis=1, kind="stable")[:, :top]
            row, rank = np.nonzero(np.take_along_axis(kept, first, axis=1))
            item = first[row, rank]
            yield some[row], base[row] + item, again[row, item], rank + 1


def search(items: DataFrame, asked: DataFrame, rows: int, top: int = fixed.TOP_K, pool: int = fixed.POOL, digits: int = 6, cell_items: int = CELL) -> DataFrame:
    """(query_id, scope, item_id, text, category, score, rank) of the marked items (scope, item_id) among (scope, item_id, text, embedding, category); ``rows`` is the number of items."""
    cells = max(1, -(-rows // cell_items))
    parts = max(items.sparkSession.sparkContext.defaultParallelism, -(-cells // CELLS))
    dealt = lambda df, scope: df.filter(F.col(scope).isNotNull()).withColumn("cell", F.pmod(F.xxhash64(scope), F.lit(cells))).repartition(parts, "cell")
    # words are cut after the shuffle
    x = dealt(items.select("scope", "item_id", "text", "embedding", "category"), "scope").withColumn("tokens", text.tokens(F.col("text")))
    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = f"query_id {kind['item_id']}, scope {kind['scope']}, item_id {kind['item_id']}, text {kind['text']}, category {kind['category']}, score double, rank int"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            right = right.take(pc.sort_indices(right, sort_keys=[("scope", "ascending"), ("item_id", "ascending")], null_placement="at_start")).combine_chunks()
            names, ids = pc.unique(right.column("scope")), pc.unique(right.column("item_id"))
            code = lambda column, known: np.asarray(pc.fill_null(pc.index_in(column, value_set=known), -1)).astype(np.int64)
            of, own = code(right.column("scope"), names), code(left.column("of_scope"), names)
            sizes, mark = np.bincount(of, minlength=len(names)), code(left.column("marked"), ids)
            known = (own >= 0) & (mark >= 0) & np.asarray(left.column("marked").is_valid())
            q = np.nonzero(np.isin(of * len(ids) + code(right.column("item_id"), ids), (own * len(ids) + mark)[known]))[0]
            found = list(_best(right, q, of, np.cumsum(sizes) - sizes, sizes, top, pool, digits))
        q, item, score, rank = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, t) for t in (np.int64, np.int64, float, np.int64))
        best = right.take(pa.array(item))
        columns = {"query_id": right.column("item_id").take(pa.array(q)), **{c: best.column(c) for c in ("scope", "item_id", "text", "category")}}
        return pa.table({**columns, "score": pa.array(score), "rank": pa.array(rank.astype(np.int32))})

    marks = dealt(asked.select(F.col("scope").alias("of_scope"), F.col("item_id").alias("marked")), "of_scope")
    return marks.groupBy("cell").cogroup(x.groupBy("cell")).applyInArrow(run, schema)
