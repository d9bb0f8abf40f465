"""Byte strings of a given length that occur more than once are cut out of all texts: a suffix order finds them.

1. *Anchors.* In each window of ``w`` bytes the least hash of ``q`` bytes (the last one on ties) is an anchor; it owns the starts whose window
   chose it. Equal strings choose alike, so texts fall into phrases between anchors in the same way wherever they are
   equal: two equal strings of ``length`` bytes share the ``length - w + 1`` bytes after their first anchor (its *core*), and all phrases that end within
   ``length - 2w - q + 2`` bytes of it. A phrase has ``w`` bytes at most, and ``w`` is such that the first ``PHRASES`` phrases, the anchor's *prefix*, always end there:
   prefixes of one number of symbols are adjacent in a suffix order, those of several numbers need not be. Phrases are the symbols, about 40 bytes of text each.
2. *What can repeat at all.* Texts that occur more than once are looked at once. Of the others only neighbourhoods of anchors stay whose
   core hashes like that of another anchor. This loses no repeat and decides nothing: it keeps the sorts to the part of the text that
   has a chance.
3. *Suffix order* of all phrases there (``suffixes.ranks``, difference cover). Adjacent suffixes with the same prefix form groups.
4. *Exact strings.* In a group, rows are sorted by core and by the hash (128 bits) of all bytes in which their owned starts can differ; equal neighbours have
   all these starts in common (a stretch). Where a core has more than one stretch, each gives off blocks of its starts, at equal distances from the anchor. Blocks are
   sorted likewise, by the bytes that all strings of the block hold and then by all its bytes; where these leave more than one stretch, each gives off its single
   strings (128-bit hashes), and these are compared: that settles strings whose ends lie between anchors.

Rows that pass between tasks are numbers and hashes; texts are shuffled only where something in them can repeat. Sorted groups are range partitions
with unique keys, so a passage that a third of all texts share is spread over tasks.

Cases: null is an empty text; texts shorter than ``length`` lose nothing; a text that occurs twice (also with one id) loses all of it if it is long
enough; overlaps inside one text count; ids may be null, repeated and of any type; long texts are one row; bytes are cut, so
the rest of a text need not be valid UTF-8 (it is given as a hash and as spans); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import as_bytes, hot_join, mark, materialise, shared_tokens, sieve, sieve_of, slices, sweep
from .suffixes import numbered, ranks

LENGTH = 400
#: Phrases of a prefix: one level of the difference cover orders so many.
PHRASES = 3
#: Fixed numbers of the hashes: a value for each byte, and an odd multiplier with its inverse.
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_PLACE = np.uint64(0xFFFFFFFF)
_NO_HASH = hashlib.sha256(b"").hexdigest()
_SPANS = "array<struct<start:bigint,stop:bigint>>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of the multiplier and of its inverse, as many as the longest text needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << n.bit_length()
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _MULTIPLIER, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _INVERSE, np.uint64)]))


_SPREAD = _mixed(_BYTE)


def _widths(length: int) -> tuple[int, int, int]:
    """Bytes of a hash (q), of a window (w), and starts of a block."""
    q = 8 if length >= 64 else 2 if length >= 16 else 1
    w = (length - q + 2) // (PHRASES + 2)
    return q, w, w // 5 + 1


class Anchors:
    """Anchors of one text of at least ``length`` bytes; ``first`` and ``last`` start that each owns, cores, phrases, and prefixes."""

    def __init__(self, text: bytes, length: int, powers: Powers):
        q, w, _ = _widths(length)
        n = len(text)
        gram = np.ndarray((n - q + 1,), f"<u{q}", text, strides=(1,)).astype(np.uint64) + np.uint64(1)
        # half a hash above the place, counted down: one minimum finds the least hash and its last place
        least = _mixed(gram * np.uint64(0xD6E8FEB86659FD93)) | _PLACE
        least -= np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width < w:
            step = min(width, w - width)
            least = np.minimum(least[step:], least[:-step])
            width += step
        fresh = np.nonzero(least[1:] != least[:-1])[0] + 1
        self.first = np.concatenate([[0], fresh])
        self.last = np.concatenate([fresh - 1, [len(least) - 1]])
        self.at = (_PLACE - (least[self.first] & _PLACE)).astype(np.int64)
        self.owners = int(np.searchsorted(self.first, n - length, "right"))  # anchors that own a start of a whole string
        self.last = np.minimum(self.last, n - length)
        powers.upto(n)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SPREAD[np.frombuffer(text, np.uint8)] * powers.up[:n], out=self._sums[1:])
        self._powers = powers
        own = self.at[: self.owners]
        self.cores = self._hash(own, own + (length - w + 1))

    @cached_property
    def phrases(self) -> np.ndarray:
        return self._hash(self.at[:-1], self.at[1:])

    @cached_property
    def prefixes(self) -> np.ndarray:
        return self._hash(self.at[: self.owners], self.at[PHRASES : PHRASES + self.owners])

    def _hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self._sums[stop] - self._sums[start]) * self._powers.down[start]
        return _mixed(h + (stop - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, row, sha, n_bytes, tokens): what can repeat, as a hash for each owning anchor."""
    row, powers = TaskContext.get().partitionId() << 33, Powers()
    for batch in batches:
        for part in slices(batch for batch in (batch,)):
            texts = as_bytes(part.column("text"))
            tokens = []
            for text in texts:
                if len(text) < length:
                    tokens.append(np.empty(0, np.int64))
                else:
                    tokens.append(Anchors(text, length, powers).cores)
            ends = np.cumsum([0, *map(len, tokens)])
            rows = pa.array(range(row, row + len(texts)), pa.int64())
            row += len(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), rows, part.column("sha"), pa.array([len(t) for t in texts], pa.int64()), lists], names=["id", "row", "sha", "n_bytes", "tokens"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each text that a task meets."""
    seen: set[str] = set()
    for batch in batches:
        names = batch.column("sha").to_pylist()
        new = [i for i, s in enumerate(names) if not (s in seen or seen.add(s))]
        if new:
            yield batch.take(pa.array(new))


_STRINGS = "doc long, idx long, sym long, owner boolean, prefix long, core long, h1 long, h2 long"
_BLOCKS = "core long, h1 long, h2 long, doc long, begin long, many long"


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The prefixes of the anchors that can repeat, and what these own."""
    powers = Powers()
    for batch in batches:
        for part in slices(batch for batch in (batch,)):
            for text, doc, asked in zip(as_bytes(part.column("text")), part.column("row").to_pylist(), part.column("ats")):
                a = Anchors(text, length, powers)
                mine = np.unique(np.asarray(asked.values))
                open_ = np.zeros(len(a.at) + 1, np.int64)
                np.add.at(open_, mine, 1)
                np.add.at(open_, mine + PHRASES, -1)
                idx = np.nonzero(np.cumsum(open_))[0]
                owner = np.isin(idx, mine)
                digests = [xxhash.xxh3_128_digest(text[a.first[i] : a.last[i] + length], int(a.at[i] - a.first[i])) if o else bytes(16) for i, o in zip(idx.tolist(), owner.tolist())]
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                own = np.where(owner, idx, 0)
                columns = [np.full(len(idx), doc, np.int64), idx.astype(np.int64), a.phrases[idx], owner, a.prefixes[own], a.cores[own], h[:, 0], h[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _STRINGS.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The blocks of starts that the asked anchors own: what all strings of a block hold, all bytes of those owned, first start, and how many."""
    powers, size = Powers(), _widths(length)[2]
    for batch in batches:
        for part in slices(batch for batch in (batch,)):
            for text, doc, asked in zip(as_bytes(part.column("text")), part.column("row").to_pylist(), part.column("asked").to_pylist()):
                a = Anchors(text, length, powers)
                cores, digests, starts, many = [], [], [], []
                for at, first, last in zip(a.at[asked].tolist(), a.first[asked].tolist(), a.last[asked].tolist()):
                    for block in range((at - last) // size, (at - first) // size + 1):
                        near, far = max(block * size, at - last), min(block * size + size - 1, at - first)
                        cores.append(xxhash.xxh3_64_intdigest(text[at - block * size : at - block * size - size + 1 + length], block))
                        digests.append(xxhash.xxh3_128_digest(text[at - far : at - near + length], near << 32 | far))
                        starts.append(at - far)
                        many.append(far - near + 1)
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [np.array(cores, np.uint64).view(np.int64), h[:, 0], h[:, 1], np.full(len(starts), doc, np.int64), np.array(starts, np.int64), np.array(many, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _BLOCKS.split(", ")])


def _single(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(token, doc, start) of every string of the asked blocks."""
    for batch in batches:
        for part in slices(batch for batch in (batch,)):
            for text, doc, asked in zip(as_bytes(part.column("text")), part.column("row").to_pylist(), part.column("asked").to_pylist()):
                starts = [i for b in asked for i in range(b["begin"], b["begin"] + b["many"])]
                tokens = [xxhash.xxh3_128_digest(text[i : i + length]) for i in starts]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(np.full(len(starts), doc, np.int64)), pa.array(starts, pa.int64())], names=["token", "doc", "start"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(sha, n_removed, spans, kept_sha256) of texts with repeats: runs of starts, and anchors whose owned strings all repeat."""
    powers = Powers()
    for batch in batches:
        for part in slices(batch for batch in (batch,)):
            out = []
            for text, sha, pieces, anchors in zip(as_bytes(part.column("text")), part.column("sha").to_pylist(), part.column("pieces"), part.column("anchors").to_pylist()):
                open_ = np.zeros(len(text) + 1, np.int64)
                if pieces.is_valid:
                    starts, many = (np.asarray(pieces.values.field(k)) for k in ("begin", "many"))
                    np.add.at(open_, starts, 1)
                    np.add.at(open_, starts + many - 1 + length, -1)
                if anchors:
                    a, k = Anchors(text, length, powers), np.array(anchors)
                    np.add.at(open_, a.first[k], 1)
                    np.add.at(open_, a.last[k] + length, -1)
                gone = np.cumsum(open_)[:-1] > 0
                edges = np.nonzero(np.diff(np.concatenate([[False], gone, [False]])))[0].reshape(-1, 2)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((sha, int(gone.sum()), [{"start": int(s), "stop": int(e)} for s, e in edges], hashlib.sha256(kept).hexdigest()))
            if out:
                kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["sha", "n_removed", "spans", "kept_sha256"])


def _stretches(rows: DataFrame, group: list[str], place: str, tag: str) -> DataFrame:
    """``rows`` sorted into stretches of equal (group, h1, h2): ``repeated`` where a stretch has more rows, ``first`` for one row of each."""
    whole = [*group, "h1", "h2"]
    found = numbered(rows, [*whole, "doc", place], whole, tag=tag)
    out = found.withColumn("first", F.col("at") == F.col("name"))
    out.stored_at = found.stored_at
    return out


def _mixed_groups(found: DataFrame, group: list[str], columns: list[str], tag: str) -> DataFrame:
    """One row of each stretch in groups that have more than one."""
    first = found.filter("first").select("doc", *group, *columns)
    mixed = first.groupBy(*group).agg(F.count("*").alias("stretches")).filter("stretches > 1").select(*group)
    return hot_join(materialise(first, tag), mixed, group, "doc")


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row; spans are byte ranges [start, stop)."""
    if length < 8:
        raise ValueError("length must be 8 bytes or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = documents.schema[id_col].dataType.simpleString()
    base = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    spark, begin = documents.sparkSession, mark()
    scan = materialise(base.mapInArrow(lambda it: _scan(it, length), f"id {kind}, row long, sha string, n_bytes long, tokens array<long>"), "repeats-scan")

    ids = materialise(scan.drop("tokens"), "repeats-ids")
    texts = materialise(ids.groupBy("sha").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")), "repeats-texts")
    rows = scan.select("row", "tokens").join(texts.filter(F.col("n_bytes") >= length).select("row"), "row", "left_semi")
    rows = materialise(rows, "repeats-hashes")
    sweep(spark, begin, ids, texts, rows)
    hints = shared_tokens(rows.select("row", F.posexplode("tokens").alias("at", "token")), "row")
    hints = hints.groupBy("row").agg(F.collect_list("at").alias("ats")).join(texts.select("row", "sha"), "row")
    hints = materialise(hints, "repeats-hints")
    sweep(spark, begin, ids, texts, hints)
    single = base.select("sha", "text").join(sieve(hints, "sha"), sieve_of(F.col("sha")) == F.col("sieve"), "left_semi")
    single = single.mapInArrow(_once, "sha string, text string").join(hints, "sha").dropDuplicates(["sha"])
    alive = materialise(single.select("row", "sha", "text", "ats"), "repeats-alive")
    sweep(spark, begin, ids, texts, alive)

    strings = materialise(alive.mapInArrow(lambda it: _strings(it, length), _STRINGS), "repeats-strings")
    order = ranks(strings.select("doc", "idx", "sym"), PHRASES)
    owners = strings.filter("owner").select("doc", "idx", "prefix", "core", "h1", "h2").join(order, ["doc", "idx"])
    # adjacent suffixes with equal prefixes; then equal stretches next to each other inside of a group
    groups = numbered(owners, ["rank", "doc", "idx"], ["prefix"], tag="repeats-order")
    sweep(spark, begin, ids, texts, alive, groups)
    groups = groups.filter("repeated").select("doc", "idx", F.col("name").alias("grp"), "core", "h1", "h2")
    found = _stretches(groups, ["grp", "core"], "idx", "repeats-stretches")
    sweep(spark, begin, ids, texts, alive, found)
    asked = _mixed_groups(found, ["grp", "core"], ["idx"], "repeats-asked").groupBy(F.col("doc").alias("row")).agg(F.collect_list("idx").alias("asked"))
    blocks = materialise(alive.join(asked, "row").select("row", "text", "asked").mapInArrow(lambda it: _blocks(it, length), _BLOCKS), "repeats-blocks")
    blocks = _stretches(blocks, ["core"], "begin", "repeats-blocks")
    sweep(spark, begin, ids, texts, alive, found, blocks)
    asked = _mixed_groups(blocks, ["core"], ["begin", "many"], "repeats-asked").groupBy(F.col("doc").alias("row")).agg(F.collect_list(F.struct("begin", "many")).alias("asked"))
    strings = alive.join(asked, "row").select("row", "text", "asked").mapInArrow(lambda it: _single(it, length), "token binary, doc long, start long")
    starts = shared_tokens(materialise(strings, "repeats-strings"), "start").select("doc", F.col("start").alias("begin"), F.lit(1).cast("long").alias("many"))
    pieces = starts.unionByName(blocks.filter("repeated").select("doc", "begin", "many")).groupBy(F.col("doc").alias("row")).agg(F.collect_list(F.struct("begin", "many")).alias("pieces"))
    whole = found.filter("repeated").groupBy(F.col("doc").alias("row")).agg(F.collect_list("idx").alias("anchors"))
    cut = alive.join(pieces.join(whole, "row", "full"), "row").select("sha", "text", "pieces", "anchors").mapInArrow(lambda it: _cut(it, length), f"sha string, n_removed long, spans {_SPANS}, kept_sha256 string")

    none = F.array().cast(_SPANS)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    twice = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    facts = texts.join(cut.withColumnRenamed("sha", "of"), F.col("sha") == F.col("of"), "left").select(
        "sha",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(twice, all_).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(twice, F.lit(_NO_HASH)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    done = hot_join(ids, materialise(facts, "repeats-facts"), ["sha"], "row")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
