"""Lines that repeat across documents: two Bloom filters, then an exact check of the suspects only.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased; keys under
``min_chars`` code points never count. A key found in two documents or more loses all its lines but those in
the smallest document id that holds it.

1. Every task turns the distinct keys of each document into 64-bit hashes and stores, for each of the segments
   of the hash space, the distinct hashes with a mark for those it has met twice. A key costs a task one
   entry, however many of its documents hold it. The number of segments follows the size of the input.
2. Each segment keeps a Bloom filter of hashes seen once and one of those seen twice: a hash that the
   first filter already holds goes to the second. Both have ``BITS_PER_KEY`` bits for each hash there is.
3. If the second filters together fit in ``broadcast_bytes``, they are broadcast and documents are read again, each asking
   for its own keys. If they don't, they stay where they are: the segment gives off the suspected hashes
   themselves, and these meet the hashes of the lines in a join. Either way only keys that a filter knows (repeats, and
   false alarms at the filter's rate) are shuffled, as text, for the exact count and the smallest document.
4. Only documents that hold a suspect meet the list of their lines to drop; the others are finished in the
   same pass that tests the filter.

Cases: null text is one empty line; rows that repeat a document id count as the same document and each
keep or lose their own lines; ids may be of any type with an order; a null id is a document that comes after all
others; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import LOWER, as_bytes, hot_join, materialise, slices

MIN_CHARS = 10
BITS_PER_KEY = 12
PROBES = 4
#: Bytes of input for a segment, and the least and most segments.
SEGMENT_BYTES, LEAST_PARTS, MOST_PARTS = 64 << 20, 64, 1 << 16
#: Filters up to this size are broadcast.
BROADCAST_BYTES = 128 << 20

_BLANK = b" \t\n\v\f\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line; None where it has too few code points to count."""
    key = line.strip(_BLANK)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.translate(LOWER)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """[probe, hash]: bit positions inside a segment of ``bits`` bits, by double hashing."""
    a = hashes & np.uint64(0xFFFFFFFF)
    b = (hashes >> np.uint64(29)) | np.uint64(1)
    return (a[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * b[None, :]) % np.uint64(bits)


class Bloom:
    """A segment's filter as an array of one byte a bit while it is built."""

    def __init__(self, bits: int):
        self.bits, self.on = bits, np.zeros(bits, np.bool_)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.on[_probes(hashes, self.bits)].all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        self.on[_probes(hashes, self.bits).ravel()] = True

    def packed(self) -> bytes:
        return np.packbits(self.on, bitorder="little").tobytes()


def _segments(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The segment of each hash: its highest bits. ``parts`` is a power of two."""
    return (hashes >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(hashes), np.int64)


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _seen(batches: Iterator[pa.RecordBatch], min_chars: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, n, once, twice): for each segment, packed hashes met in one document and in more documents."""

    def out(hashes: list[int]) -> pa.RecordBatch:
        found, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
        numbers, starts = np.unique(_segments(found, parts), return_index=True)
        once, twice, sizes = [], [], []
        for lo, hi in zip(starts, [*starts[1:], len(found)]):
            part, n = found[lo:hi], counts[lo:hi]
            once.append(part[n == 1].tobytes())
            twice.append(part[n > 1].tobytes())
            sizes.append(hi - lo)
        columns = [pa.array(numbers, pa.int32()), pa.array(sizes, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "n", "once", "twice"])

    held: list[int] = []
    for batch in slices(batches):
        for text in as_bytes(batch.column("text")):
            held += map(xxhash.xxh3_64_intdigest, _keys(text, min_chars))
        if len(held) > 2_000_000:
            yield out(held)
            held = []
    if held:
        yield out(held)


def _filters(batches: Iterator[pa.RecordBatch], bits: int, suspects: bool) -> Iterator[pa.RecordBatch]:
    """Segments one after the other: (part, bits) with the second filter, or (hash) with what went to it."""

    def out(part: int, second: Bloom, found: list[np.ndarray]) -> pa.RecordBatch:
        if suspects:
            hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *found]))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([second.packed()], pa.binary())], names=["part", "bits"])

    now, first, second, found = None, None, None, []
    for batch in batches:
        for part, once, twice in zip(*(batch.column(n).to_pylist() for n in ("part", "once", "twice"))):
            if part != now:
                if now is not None:
                    yield out(now, second, found)
                now, first, second, found = part, Bloom(bits), Bloom(bits), []
            one, more = np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64)
            again = np.concatenate([one[first.has(one)], more])
            if suspects:
                found.append(again[~second.has(again)])
            second.add(again)
            first.add(one)
            first.add(more)
    if now is not None:
        yield out(now, second, found)


def _power(n: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def repeats(documents: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS, bits_per_key: float = BITS_PER_KEY, broadcast_bytes: int = BROADCAST_BYTES, parts: int | None = None) -> tuple[np.ndarray | None, DataFrame | None]:
    """What the second filters know: [part, byte] if that is small enough, else a table of suspected hashes."""
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # Spark's estimate: only costs hang on it
    parts = parts or _power(size / SEGMENT_BYTES, LEAST_PARTS, MOST_PARTS)
    seen = documents.select(F.col(text_col).alias("text")).mapInArrow(lambda it: _seen(it, min_chars, parts), "part int, n long, once binary, twice binary")
    seen = materialise(seen, "lines-seen")
    hashes = seen.groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    own = _power(hashes * bits_per_key, 1 << 10, 1 << 32)
    dealt = seen.repartition("part").sortWithinPartitions("part")
    if parts * own // 8 > broadcast_bytes:
        return None, materialise(dealt.mapInArrow(lambda it: _filters(it, own, True), "hash long"), "lines-suspects")
    table = np.zeros((parts, own // 8), np.uint8)
    for part, packed in dealt.mapInArrow(lambda it: _filters(it, own, False), "part int, bits binary").collect():  # ``broadcast_bytes`` at most
        table[part] = np.frombuffer(packed, np.uint8)
    return table, None


def _suspects(table: np.ndarray, keys: list[bytes]) -> list[bytes]:
    """Those of the keys that the filter knows."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    at = _probes(hashes, table.shape[1] * 8)
    known = ((table[_segments(hashes, len(table))[None, :], at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
    return [keys[i] for i in np.nonzero(known)[0]]


def _with_known(docs: DataFrame, suspects: DataFrame, min_chars: int, kind: str) -> DataFrame:
    """``docs`` (id, text) with the suspected hashes of each row's document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [np.array([xxhash.xxh3_64_intdigest(k) for k in _keys(t, min_chars)], np.uint64).view(np.int64) for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], names=["id", "hashes"])

    lines = docs.mapInArrow(run, f"id {kind}, hashes array<long>").select("id", F.explode("hashes").alias("hash"))
    lines = materialise(lines, "lines-hashes")
    known = hot_join(lines, suspects, ["hash"], "id").groupBy("id").agg(F.collect_set("hash").alias("known"))
    known = known.withColumnRenamed("id", "of")
    return docs.join(known, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "known")


def dedup_lines(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    bits_per_key: float = BITS_PER_KEY,
    broadcast_bytes: int = BROADCAST_BYTES,
    parts: int | None = None,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256, kept_text) for every row; kept_text is null where nothing was dropped."""
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table, hashes = repeats(docs, "text", min_chars, bits_per_key, broadcast_bytes, parts)
    shared = None if table is None else documents.sparkSession.sparkContext.broadcast(table)
    if hashes is not None:
        docs = _with_known(docs, hashes, min_chars, kind)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = as_bytes(part.column("text"))
            groups = [list(_keys(text, min_chars)) for text in texts]
            if shared is not None:
                keys = [k for own in groups for k in own]
                known = set(_suspects(shared.value, keys)) if keys else set()
                lists = [[k for k in own if k in known] for own in groups]
            else:
                of_row = [set(k or ()) for k in part.column("known").to_pylist()]
                lists = [[k for k in own if np.uint64(xxhash.xxh3_64_intdigest(k)).astype(np.int64) in known] if known else [] for own, known in zip(groups, of_row)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
                    pa.array([None if s else hashlib.sha256(t).hexdigest() for t, s in zip(texts, lists)], pa.string()),
                    pa.array([t if s else None for t, s in zip(texts, lists)], pa.binary()),
                    pa.array([s or None for s in lists], pa.list_(pa.binary())),
                ],
                names=["id", "n_lines", "sha", "text", "suspects"],
            )

    tested = materialise(docs.mapInArrow(test, f"id {kind}, n_lines long, sha string, text binary, suspects array<binary>"), "lines")
    held = tested.filter("suspects is not null")
    order = F.struct(F.col("id").isNull().alias("last"), "id")  # a null id comes after all others
    pairs = materialise(held.select("id", F.explode("suspects").alias("key")).distinct(), "lines-pairs")
    found = pairs.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    found = found.filter("n > 1").select("key", F.col("first.id").alias("first"))
    drops = hot_join(pairs, found, ["key"], "id").filter(~F.col("id").eqNullSafe(F.col("first")))
    drops = drops.groupBy(F.col("id").alias("of")).agg(F.collect_list("key").alias("drop"))
    met = held.join(drops, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "n_lines", "text", "drop")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            dropped, texts, shas = [], [], []
            for text, drop in zip(part.column("text").to_pylist(), part.column("drop").to_pylist()):
                kept = text
                if drop:
                    gone, lines = set(drop), text.split(b"\n")
                    stay = [x for x in lines if line_key(x, min_chars) not in gone]
                    kept = b"\n".join(stay)
                    dropped.append(len(lines) - len(stay))
                else:
                    dropped.append(0)
                texts.append(kept if drop else None)
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(dropped, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
            )

    met = met.mapInArrow(rebuild, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    clean = tested.filter("suspects is null").select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return clean.unionByName(met).withColumnRenamed("id", id_col)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document of ``documents``."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
