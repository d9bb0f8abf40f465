"""Token ids in training order: a keyed permutation and fixed-stride shards.

Documents are encoded with an existing byte-level vocabulary (its path is a parameter), each closed by an end
token, and laid end to end in the order of a hash of their id; every ``length`` tokens are a sequence (the
last is filled with end tokens). Where a document begins in this stream comes from sums over 2^18 hash ranges
in 2^10 groups (a few MB at most, whatever the input), then a running sum inside each range, so no task sees the whole stream.

The slot of sequence s is a Feistel network over the smallest even number of bits that covers the number of
sequences, keyed by ``seed`` and applied again while its result is out of range (cycle-walking). It is a bijection
that any task computes for itself: no sort by random numbers, no table of places.

A shard is ``per_shard`` consecutive slots, so it can be told from the slot alone: the rows of a shard go to one
task by its number (ranges of shards, without sampling), and it writes them at slot times stride. One row a
shard holds these bytes (little-endian 16 or 32 bit ids) with what a reader needs; the row is written by
Spark's own committer to any store, a rerun of a lost task gives the same bytes, and ``read_from`` resumes at a
slot by opening the shards from there on: its filter on ``first_slot`` is pushed down to the files.

Cases: null text is a lone end token; rows without an id are placed by a hash of their text; rows that repeat an id follow one another in
the order of their tokens; an empty table gives no shards; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 1024
PER_SHARD = 512
SEED = 20_240_601
ROUNDS = 6
RANGE_BITS, GROUP_BITS = 18, 10
#: Bytes of shards that a task writes, where there is enough of them for all cores.
TASK_BYTES = 64 << 20

_ENCODERS: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The encoder of a rank file, opened once a process. Its first free id is the end token."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class Feistel:
    """A keyed bijection of [0, n)."""

    def __init__(self, n: int, seed: int, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(xxhash.xxh64_intdigest(struct.pack("<QI", seed, r), seed=seed)) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = x * np.uint64(0x9E3779B97F4A7C15) + key
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (z ^ (z >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h = np.uint64(self.half)
        a, b = x >> h, x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            a, b = (b ^ self._mix(a, key), a) if back else (b, a ^ self._mix(b, key))
        return (a << h) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(order_key, n, tokens): every document's ids with its end token, as bytes."""
    width = np.dtype("<u2" if encoder(vocabulary).n_vocab < 1 << 16 else "<u4")
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(F.col(id_col)))
    docs = documents.select(key.alias("order_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for part in slices(batches):
            ids = [np.array([*own.encode_ordinary(t or ""), own.n_vocab], width) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                names=["order_key", "n", "tokens"],
            )

    return docs.mapInArrow(run, "order_key long, n long, tokens binary")


SCHEMA = "shard long, first_slot long, n_sequences long, stride long, total_sequences long, total_tokens long, payload binary"


def materialise_order(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = SEED) -> DataFrame:
    """One row a shard, as ``SCHEMA``."""
    end = encoder(vocabulary).n_vocab
    width = np.dtype("<u2" if end < 1 << 16 else "<u4")
    tokens = encode(documents, id_col, text_col, vocabulary).withColumn("range", F.shiftright("order_key", 64 - RANGE_BITS))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("order_key", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    tokens = materialise(tokens.select("range", "n", F.coalesce(inside, F.lit(0)).alias("inside"), "tokens"), "tokens")
    ranges = tokens.groupBy("range").agg(F.sum("n").alias("n"))
    up_to = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = materialise(ranges.withColumn("group", F.shiftright("range", RANGE_BITS - GROUP_BITS)), "token-ranges")
    groups = ranges.groupBy("group").agg(F.sum("n").alias("n")).select("group", up_to(Window.orderBy("group")).alias("below"))
    inside_group = ranges.select("group", "range", "n", up_to(Window.partitionBy("group").orderBy("range")).alias("base"))
    ranges = materialise(inside_group.join(groups, "group").select("range", "n", (F.col("base") + F.col("below")).alias("base")), "token-ranges")
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = -(-total // length)
    shards = -(-count // per_shard)
    placed = tokens.join(F.broadcast(ranges.select("range", "base")), "range").select((F.col("base") + F.col("inside")).alias("at"), "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slot, at, tokens): what each document gives to each sequence."""
        feistel = Feistel(max(count, 1), seed)
        for part in slices(batches):
            first, place, data = [], [], []
            for at, raw in zip(part.column("at").to_pylist(), part.column("tokens").to_pylist()):
                n = len(raw) // width.itemsize
                edges = [at, *range((at // length + 1) * length, at + n, length), at + n]
                for lo, hi in zip(edges, edges[1:]):
                    first.append(lo // length)
                    place.append(lo % length)
                    data.append(raw[(lo - at) * width.itemsize : (hi - at) * width.itemsize])
            slots = feistel.slot(np.array(first, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), pa.array(place, pa.int32()), pa.array(data, pa.binary())], names=["shard", "slot", "at", "tokens"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards one after the other: pieces arrive sorted by shard."""

        def out(shard: int, page: np.ndarray) -> pa.RecordBatch:
            n = min(per_shard, count - shard * per_shard)
            values = [shard, shard * per_shard, n, length * width.itemsize, count, total, page[: n * length].tobytes()]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["shard", "first_slot", "n_sequences", "stride", "total_sequences", "total_tokens", "payload"])

        now, page = None, np.empty(0, width)
        for batch in batches:
            for shard, slot, at, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "at", "tokens"))):
                if shard != now:
                    if now is not None:
                        yield out(now, page)
                    now, page = shard, np.full(per_shard * length, end, width)
                start = (slot - shard * per_shard) * length + at
                page[start : start + len(raw) // width.itemsize] = np.frombuffer(raw, width)
        if now is not None:
            yield out(now, page)

    pieces = placed.mapInArrow(cut, "shard long, slot long, at int, tokens binary")
    spread = -(-shards // (2 * documents.sparkSession.sparkContext.defaultParallelism))
    each = max(1, min(spread, TASK_BYTES // (per_shard * length * width.itemsize)))  # shards to a task
    tasks = max(1, -(-shards // each))
    dealt = pieces.repartitionById(tasks, F.expr(f"cast(shard div {each} as int)"))
    return dealt.sortWithinPartitions("shard").mapInArrow(write, SCHEMA)


def shards_from(shards: DataFrame, slot: int = 0) -> DataFrame:
    """The shards that hold ``slot`` and what follows; the filter reaches the files, which hold shards in order."""
    stride = shards.agg(F.max("n_sequences")).first()[0] or 1  # all shards but the last are full
    return shards.filter(F.col("first_slot") >= slot // stride * stride)


def read_from(shards: DataFrame, slot: int = 0, wide: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from ``slot`` on, in order, shard by shard."""
    rows = shards_from(shards, slot).orderBy("first_slot").toLocalIterator(prefetchPartitions=True)
    for row in rows:
        page = np.frombuffer(bytes(row.payload), "<u4" if wide else "<u2").reshape(row.n_sequences, -1)
        for k in range(max(0, slot - row.first_slot), row.n_sequences):
            yield row.first_slot + k, page[k]


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return materialise_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
