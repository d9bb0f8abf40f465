"""Byte-pair token counts of texts: merges run once for each distinct word of a batch, not for each text.

A text is split by the pattern that goes with the vocabulary. Nearly all words are tokens of the vocabulary and count one; the others
are merged in the task that meets them, which remembers the short ones. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType

#: The rank file of a public byte-level vocabulary; a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to it, with white space as in Unicode.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What is broadcast is at most so many tokens; a larger vocabulary is refused.
MOST_TOKENS = 1 << 20
#: Words that a task remembers at most, and their bytes at most.
REMEMBERED, SHORT = 1 << 16, 64


def vocabulary(spark: SparkSession, path: str = RANKS) -> DataFrame:
    """(token binary, rank) of a rank file: base64 and a number a line."""
    parts = F.split("value", " ")
    return spark.read.text(path).filter("value <> ''").select(F.unbase64(F.get(parts, F.lit(0))).alias("token"), F.get(parts, F.lit(1)).cast("int").alias("rank"))


def merged_length(word: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a word: the adjacent pair of the lowest rank (the leftmost of equals) merges until no pair has a rank.

    Pairs wait in a heap over a linked list, so that a word of n bytes takes n log n steps, not n squared.
    """
    end = len(word)
    after = list(range(1, end + 1))  # where the piece that starts here ends, and the next one starts
    before = list(range(-1, end))
    heap: list[tuple[int, int, int, int]] = []

    def offer(at: int) -> None:
        middle = after[at]
        if middle < end and (rank := ranks.get(word[at : after[middle]])) is not None:
            heapq.heappush(heap, (rank, at, middle, after[middle]))

    for at in range(end - 1):
        offer(at)
    n = end
    gone = bytearray(end + 1)
    while heap:
        _, at, middle, stop = heapq.heappop(heap)
        if gone[at] or after[at] != middle or gone[middle] or after[middle] != stop:
            continue  # one of the two has been merged since
        gone[middle] = 1
        after[at] = stop
        before[stop] = at
        n -= 1
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return n


def _counter(ranks: Broadcast, depth: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Lists of words become their numbers of tokens; ``depth`` lists around them stay."""
    merged: dict[bytes, int] = {}

    def pieces(word: bytes, known: dict[bytes, int]) -> int:
        if word in known:
            return 1
        n = merged.get(word)
        if n is None:
            n = merged_length(word, known)
            if len(word) <= SHORT:
                if len(merged) >= REMEMBERED:
                    merged.clear()
                merged[word] = n
        return n

    def lengths(lists: pa.Array) -> np.ndarray:
        return np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = ranks.value
        for lists in batches:
            around = []
            for _ in range(depth):
                around.append(lengths(lists))
                lists = lists.flatten()
            coded = lists.flatten().dictionary_encode()
            sizes = np.array([pieces(w, known) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            sums = np.concatenate([[0], np.cumsum(sizes[np.asarray(coded.indices)])]) if len(coded) else np.zeros(1, np.int64)
            ends = np.cumsum(lengths(lists))
            out = pa.array(sums[ends] - sums[ends - lengths(lists)], pa.int32())
            for n in reversed(around):
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), out)
            yield out

    return run


def counted(texts: DataFrame, keys: list[str], text: str = "text", out: str = "n_tokens", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``texts`` with ``out``, the number of byte-pair tokens of ``text`` (null and empty texts: 0).

    ``text`` may hold arrays of texts (also nested); ``out`` then holds arrays of numbers. ``keys`` name a row, for counters
    that join; this one counts where the rows are.
    """
    spark = texts.sparkSession
    found = vocabulary(spark, path).limit(MOST_TOKENS + 1).collect()
    if len(found) > MOST_TOKENS:
        raise ValueError(f"{path} has more than {MOST_TOKENS} tokens")
    ranks = spark.sparkContext.broadcast({bytes(r.token): r.rank for r in found})

    def words(column: Column, kind: DataType) -> Column:
        if isinstance(kind, ArrayType):
            return F.transform(column, lambda x: words(x, kind.elementType))
        return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))

    def numbers(kind: DataType) -> DataType:
        return ArrayType(numbers(kind.elementType)) if isinstance(kind, ArrayType) else IntegerType()

    kind, depth = texts.schema[text].dataType, 0
    inner = kind
    while isinstance(inner, ArrayType):
        inner, depth = inner.elementType, depth + 1
    run = _counter(ranks, depth)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return texts.withColumn(out, F.arrow_udf(count, numbers(kind))(words(F.col(text), kind)))
