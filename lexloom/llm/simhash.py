"""SimHash near-duplicates under a Hamming limit, found with a pigeonring filter.

Fingerprint: A-Z is lower-cased; words are runs of bytes other than space and \\t-\\r; every ``width``-word
shingle (repeats included; fewer words: the whole sequence) is hashed with XXH64, seed 42, and a bit is set
if over half of the hashes have it. Texts without words, and null texts, have fingerprint zero.

Candidates: the 64 bits form a ring of ``SEGMENTS`` segments of equal width. If two fingerprints differ in
at most ``limit`` bits, then some start on the ring exists from which, for every chain length l, the
first l consecutive segments together differ in at most floor(l * limit / SEGMENTS) bits. The leading chains
with budget zero must be equal, so fingerprints meet by equality of that prefix (a plain equi-join on
(start, prefix bits)); the longer chains are then tested one after the other, and only pairs that pass
all of them get the full Hamming check.

Exact copies are collapsed to one row for each fingerprint before that, so a group of copies costs one row.
Distinct fingerprints may still crowd in one bucket. The bits that a bucket has not fixed are then segments of a
smaller ring: in ``limit`` + 1 segments a pair has one without a difference, so the bucket is split by the
equality of each, and again, until a bucket holds ``CROWD`` fingerprints or leaves so few bits free
that it cannot hold more. No bucket lists more pairs than ``CROWD`` allows, and every pair within the limit is found.

Components come from alternating large-star and small-star rounds on the table of links, written to the
shared store each round; nothing about all documents goes to the driver but a count and a checksum. Hubs (a node
with very many links, a fingerprint of very many copies) meet their rows by ``store.hot_join``.

Two bits of 64 are near-identity: measured on the test tables, pairs with a Jaccard similarity of 0.8 to 0.9 over
5-word shingles differ in 5 to 14 bits, and no index by equal segments can reach that far (a budget of 14
bits leaves no segment of useful width without a difference). ``keep_one`` therefore adds, for a given
``similarity``, the links that all pairs of texts with a Jaccard similarity (of their sets of 64-bit
shingle hashes) of that or more would make. Three filters, none of which can lose a pair, come first: of the lowest
hashes of a text, so many must be shared; of all its shingles, so many must be in another text left; and two
such texts share one of their rarest shingles, the bucket in which they meet. In every bucket the
text with the fewest shingles of its own (the one that others are copies of) is the *hub*, and all others that
their size and place in the bucket allow are compared with it, exactly. Members that are joined then need no comparison with
each other; a second round has more hubs (``HUBS``) for what is left. What is then left, members of one bucket that are still in different components, is compared in blocks of
``BLOCK`` texts, so that no task holds a bucket and no row is written for a pair.

Cases: repeated rows are rows; null ids are linked like others, and a component's id is the smallest
non-null doc_id (null only if it has none); empty tables give empty results. ``keep_one`` leaves rows without an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import LOWER, as_bytes, hot_join, mark, materialise, shared_tokens, sieve, sieve_of, slices, sweep

SEED = 42
WIDTH = 3
LIMIT = 2
SEGMENTS = 8
CROWD = 64
SLACK = 1e-9
#: Hubs of a bucket in each round.
HUBS = (1, 16)
BLOCK = 256
MEET = 256

_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - width + 1
    hashes = np.fromiter([digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)))], np.uint64, n)
    padded = np.zeros((n + 254) // 255 * 255, np.uint64)  # byte lanes hold sums of up to 255 bits
    padded[:n] = hashes
    lanes = ((padded[None, :] >> _SHIFTS) & _LANES).reshape(8, -1, 255).sum(axis=2, dtype=np.uint64)
    counts = np.ascontiguousarray(lanes).view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64)  # [shift, lane]
    return sum(1 << (8 * int(lane) + int(shift)) for shift, lane in zip(*np.nonzero(2 * counts > n)))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            fps = np.array([fingerprint(t, width) for t in as_bytes(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, fp long")


def _rotated(fp, start: int, bits: int):
    """``fp`` turned so that segment ``start`` of the ring comes first (highest)."""
    k = start * bits
    return fp if not k else F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k))


def _split(level: DataFrame, width: int, parts: int) -> tuple[DataFrame, int]:
    """Buckets split by each of ``parts`` segments of their ``width`` free bits, and how many bits are free then."""
    edges = [width * k // parts for k in range(parts + 1)]
    keys = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        fixed = F.shiftrightunsigned("rest", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        free = F.shiftleft(F.shiftrightunsigned("rest", hi), lo).bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << lo) - 1).cast("long")))
        keys.append(F.struct(F.xxhash64("key", F.lit(k), fixed).alias("key"), free.alias("rest")))
    out = level.select("start", "fp", "turned", F.explode(F.array(*keys)).alias("k")).select("start", "fp", "turned", "k.key", "k.rest")
    return out, width - min(hi - lo for lo, hi in zip(edges, edges[1:]))


def links(fps: DataFrame, limit: int = LIMIT, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints ``fp`` within ``limit`` bits."""
    if 64 % segments or not 0 < limit < segments:
        raise ValueError("segments must divide 64, and limit must be below segments")
    bits = 64 // segments
    budget = [length * limit // segments for length in range(segments + 1)]
    lead = max(n for n in range(1, segments) if budget[n] == 0)  # these first segments must be equal
    width = 64 - lead * bits
    turns = F.array(*(F.struct(F.lit(s).alias("start"), _rotated(F.col("fp"), s, bits).alias("turned")) for s in range(segments)))
    level = fps.select("fp", F.explode(turns).alias("t")).select(
        "t.start", "fp", "t.turned", F.shiftrightunsigned("t.turned", width).alias("key"), F.col("t.turned").bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("rest")
    )
    ok = F.col("a.fp") < F.col("b.fp")
    diff = F.col("a.turned").bitwiseXOR(F.col("b.turned"))
    for length in range(lead + 1, segments + 1):
        if length == segments or budget[length + 1] > budget[length]:  # the other chains have the same budget as a longer one
            part = diff if length == segments else F.shiftrightunsigned(diff, 64 - length * bits)
            ok = ok & (F.bit_count(part) <= budget[length])
    near = []
    while True:
        last = 1 << width <= max(crowd, 1 << limit)  # no bucket can hold more distinct fingerprints than that
        level = materialise(level, "simhash-turned")
        sizes = level.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1")
        level = materialise(hot_join(level, sizes, ["start", "key"], "fp"), "simhash-buckets")
        few = level if last else level.filter(F.col("n") <= crowd)
        found = few.alias("a").join(few.alias("b"), ["start", "key"]).filter(ok).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        near.append(found)
        crowded = level.filter(F.col("n") > crowd)
        if last or crowded.isEmpty():
            return reduce(DataFrame.unionByName, near).distinct()
        level, width = _split(crowded, width, limit + 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b), the smallest node of its component.

    Alternating stars: in the large-star half every node joins its larger neighbours to the smallest node
    around it, in the small-star half its smaller ones. Rounds end when neither changes a link.
    """
    held = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "stars")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    last = print_of(held)
    while last[0]:
        start = mark()
        upward = held.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        below = held.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        least = upward.select("u").distinct().join(below, "u", "left").select("u", F.coalesce("m", "u").alias("m"))
        large = hot_join(upward, least, ["u"], "v").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.distinct(), "large-stars")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            hot_join(large, least, ["hi"], "lo")
            .select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.*")
            .filter("hi <> lo")
            .distinct()
        )
        old, held = held, materialise(small, "stars")
        sweep(held.sparkSession, start, held)
        now = print_of(held)
        if now == last:
            break
        last = now
    return held.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _labelled(prints: DataFrame, id_col: str, limit: int, more_links: DataFrame | None = None) -> DataFrame:
    """(id, fp, component_id, root) from a stored table (id, fp); ``root`` tells components of one name apart."""
    start = mark()
    classes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    edges = links(classes.select("fp"), limit)
    roots = components(edges if more_links is None else edges.unionByName(more_links))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = materialise(classes.join(roots, classes.fp == roots.node).select("fp", "least", "root"), "simhash-linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = hot_join(linked, named, ["root"], "fp").select("fp", "component_id", "root")
    labels = classes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    labels = materialise(labels, "simhash-labels")
    sweep(prints.sparkSession, start, labels)
    return hot_join(prints, labels, ["fp"], id_col).select(id_col, "fp", "component_id", "root")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """(id, fp, component_id) for every row of ``documents``."""
    return _labelled(materialise(fingerprints(documents, id_col, text_col, width), "simhash"), id_col, limit).drop("root")


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in ascending order."""
    words = text.translate(LOWER).split()
    grams = zip(*(words[i:] for i in range(width))) if len(words) >= width else [tuple(words)] if words else []
    digest, join = xxhash.xxh3_64_intdigest, b" ".join
    return np.unique(np.array([digest(join(g)) for g in grams], np.uint64))


def _spare(n: int, similarity: float) -> int:
    """How many of ``n`` shingles a partner of that similarity may lack."""
    return n - math.ceil(similarity * n - SLACK)


def _extra(n: int) -> int:
    """Shingles taken beyond ``_spare``: so many of the lowest ones must then be shared."""
    return max(1, n // 20)


def sketches(documents: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, fp, sid, n, need, low): the fingerprint, a digest of the shingle set, its size and its lowest hashes.

    Of these, a text with a partner of that similarity shares ``need`` or more with it. A task gives them once a digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in slices(batches, 128):
            fps, sids, sizes, needs, lows = [], [], [], [], []
            for text in as_bytes(part.column("text")):
                fps.append(fingerprint(text, width))
                own = shingles(text, width)
                n = len(own)
                sids.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(n)
                needs.append(_extra(math.ceil(similarity * n - SLACK)))  # the smallest partner sets it
                lows.append(None if sids[-1] in seen else own[: _spare(n, similarity) + _extra(n)].view(np.int64))
                seen.add(sids[-1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(np.array(v, np.uint64).view(np.int64)) for v in (fps, sids)), pa.array(sizes, pa.int64()), pa.array(needs, pa.int64()), pa.array(lows, pa.list_(pa.int64()))],
                names=[id_col, "fp", "sid", "n", "need", "low"],
            )

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, fp long, sid long, n long, need long, low array<long>")


def _alive(full: DataFrame, id_col: str) -> DataFrame:
    """(sid, least): digests that share enough of their lowest hashes with others, and the least id of each."""
    low = full.select("sid", F.explode("low").alias("token"))
    shared = shared_tokens(low, "sid").groupBy("sid").agg(F.count("*").alias("shared"))
    own = full.groupBy("sid").agg(F.min(id_col).alias("least"), F.max("need").alias("need"), F.count("low").alias("times"))
    return materialise(own.join(shared, "sid").filter("shared >= need * times").select("sid", "least"), "simhash-alive")


def _sets(documents: DataFrame, alive: DataFrame, similarity: float, id_col: str, text_col: str, width: int) -> DataFrame:
    """(sid, n, tokens, lead, own): shingles that other texts left hold too, rarest first, and how many of them lead.

    ``own`` shingles, which no other text has, come before them in the common order.
    """
    ids = alive.select("least").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            own = [shingles(t, width) for t in as_bytes(part.column("text"))]
            sids = np.array([xxhash.xxh3_64_intdigest(o.tobytes()) for o in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array([o.view(np.int64) for o in own], pa.list_(pa.int64()))], names=["sid", "tokens"])

    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), sieve_of(F.col(id_col)).alias("sieve"))
    texts = texts.join(sieve(ids, "least"), "sieve", "left_semi").join(ids, F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text")
    whole = texts.mapInArrow(run, "sid long, tokens array<long>").join(alive.select("sid"), "sid", "left_semi")
    start = mark()
    whole = materialise(whole.dropDuplicates(["sid"]), "simhash-whole")
    sweep(documents.sparkSession, mark())  # the shuffle of the texts may go
    tokens = whole.select("sid", F.explode("tokens").alias("token"))
    rare = shared_tokens(tokens, "sid").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    rare = rare.join(whole.select("sid", F.size("tokens").cast("long").alias("size")), "sid")
    spare = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(SLACK))
    own = F.col("size") - F.size("t")
    rare = rare.select("sid", F.col("size").alias("n"), F.col("t.token").alias("tokens"), (spare + 1 - own).alias("lead"), own.alias("own"))
    rare = materialise(rare.filter("lead > 0"), "simhash-rare")
    sweep(documents.sparkSession, start, rare)
    return rare


def _open(members: DataFrame, joined: DataFrame | None, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Members with the ``label`` of their component, and the buckets that hold more than one label, with hubs.

    A bucket's hubs are the members with the fewest shingles of their own in each of ``hubs`` hash classes.
    """
    if joined is None:
        rows = members.withColumn("label", F.col("sid"))
    else:
        rows = members.join(joined, members.sid == joined.node, "left").select(*members.columns, F.coalesce("root", "sid").alias("label"))
    rows = materialise(rows, "simhash-members")
    one = F.struct("own", "sid", "size", "place", "label")
    of = F.pmod(F.xxhash64("sid"), F.lit(hubs))
    every = F.array_compact(F.array(*(F.min(F.when(of == k, one)) for k in range(hubs))))
    buckets = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), every.alias("hubs"))
    return rows, materialise(buckets.filter("lo <> hi").select("token", "n", "hubs"), "simhash-buckets")


def _fit(a: str, b: str, similarity: float):
    """Whether two texts that meet can be similar, by their sizes and by what follows their places."""
    size, place = (lambda x: F.col(f"{x}size")), (lambda x: F.col(f"{x}place"))
    left = F.least(size(a) - place(a), size(b) - place(b))  # they have met for the first time: no more can be shared
    sizes = F.least(size(a), size(b)) >= similarity * F.greatest(size(a), size(b)) - SLACK
    return sizes & (left >= similarity / (1 + similarity) * (size(a) + size(b)) - SLACK)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) from pairs (sid, hub) whose shingle sets have the similarity; a hub meets ``MEET`` texts at a time."""
    pairs = materialise(pairs, "simhash-pairs")
    per = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    ways = F.greatest(F.lit(1), F.ceil(F.col("n") / MEET))
    dealt = hot_join(pairs, per, ["hub"], "sid").select("sid", "hub", F.pmod(F.xxhash64("sid"), ways).alias("way"))
    hubs = per.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("way"))
    hubs = hubs.join(sets.select(F.col("sid").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens")), "hub")
    both = dealt.join(sets.select("sid", "n", "tokens"), "sid").join(hubs, ["hub", "way"])
    shared = F.size(F.array_intersect("tokens", "hub_tokens"))
    alike = both.select("hub", "sid", "n", "hub_n", shared.alias("shared")).filter(F.col("shared") >= similarity * (F.col("n") + F.col("hub_n") - F.col("shared")) - SLACK)
    return materialise(alike.select(F.col("hub").alias("a"), F.col("sid").alias("b")), "simhash-alike")


def _allowed(i: int, right: np.ndarray, sid, n, place, label, major, similarity: float) -> np.ndarray:
    """Which of the rows ``right`` row ``i`` has to be compared with."""
    fit = (label[right] != label[i]) & (np.minimum(n[right], n[i]) >= similarity * np.maximum(n[right], n[i]) - SLACK)
    fit &= np.minimum(n[right] - place[right], n[i] - place[i]) >= similarity / (1 + similarity) * (n[right] + n[i]) - SLACK
    return fit & ((label[right] == major[right]) | (sid[right] > sid[i]))  # a pair of two minor members comes once


def _compare(group: pa.Table, similarity: float, token: int) -> tuple[list[int], list[int]]:
    """Links between the rows of a block: those of side 0 against those of side 1 in another component.

    Two texts meet in every shingle that both lead with; the first one in their common order decides.
    """
    group = group.combine_chunks()
    side, sid, n, lead, place, label, major = (group.column(c).to_numpy() for c in ("side", "sid", "n", "lead", "place", "label", "major"))
    size = pc.list_value_length(group.column("tokens")).to_numpy().astype(np.int64)
    names, flat = np.unique(pc.list_flatten(group.column("tokens")).to_numpy(), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    here = int(np.searchsorted(names, token))
    all_of, lead_of = np.zeros(len(names), bool), np.zeros(len(names), bool)
    right = np.nonzero(side == 1)[0]
    out: tuple[list[int], list[int]] = ([], [])
    for i in np.nonzero(side == 0)[0].tolist():
        own = flat[start[i] : start[i + 1]]
        all_of[own], lead_of[own[: lead[i]]] = True, True
        for j in right[_allowed(i, right, sid, n, place, label, major, similarity)].tolist():
            other = flat[start[j] : start[j + 1]]
            first = other[: lead[j]]
            first = first[lead_of[first]]
            if len(first) and first[0] == here:
                both = int(all_of[other].sum())
                if both >= similarity * (n[i] + n[j] - both) - SLACK:
                    out[0].append(int(sid[i]))
                    out[1].append(int(sid[j]))
        all_of[own], lead_of[own] = False, False
    return out


def _rest(rows: DataFrame, buckets: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components, compared block by block.

    Blocks are gone through twice: narrow rows tell which members have a partner that sizes and places allow, and only
    these bring their shingles.
    """
    counts = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
    major = counts.groupBy("token").agg(F.max(F.struct("c", "label")).alias("top"))
    buckets = buckets.join(major, "token").select("token", "n", F.col("top.label").alias("major"), F.ceil(F.col("n") / block).alias("blocks"))
    held = hot_join(rows, buckets, ["token"], "sid").withColumn("block", F.pmod(F.xxhash64("sid"), "blocks"))
    held = materialise(held.select("token", "sid", F.col("size").alias("n"), "place", "label", "major", "blocks", "block"), "simhash-open")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = held.filter("label <> major").select("*", every.alias("j")).withColumnRenamed("block", "i").withColumn("side", F.lit(0))
    right = held.select("*", every.alias("i")).withColumnRenamed("block", "j").withColumn("side", F.lit(1))
    columns = ["token", "i", "j", "side", "sid", "n", "place", "label", "major"]
    blocks = left.select(*columns).unionByName(right.select(*columns))

    def partnered(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side, sid, n, place, label, major = (group.column(c).to_numpy() for c in columns[3:])
        right, keep = np.nonzero(side == 1)[0], np.zeros(len(side), bool)
        for i in np.nonzero(side == 0)[0].tolist():
            fit = right[_allowed(i, right, sid, n, place, label, major, similarity)]
            keep[fit] = True
            keep[i] = len(fit) > 0
        return group.filter(pa.array(keep))

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        a, b = _compare(group, similarity, key[0].as_py())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    few = materialise(blocks.groupBy("token", "i", "j").applyInArrow(partnered, blocks.schema), "simhash-partnered")
    return few.join(sets.select("sid", "lead", "tokens"), "sid").groupBy("token", "i", "j").applyInArrow(settle, "a long, b long")


def _meet(rows: DataFrame, buckets: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links of the members of open buckets with their hubs, and the members that are no hubs of theirs."""
    held = materialise(hot_join(rows, buckets, ["token"], "sid"), "simhash-held")
    met = held.select("token", "sid", "size", "own", "place", "label", F.explode("hubs").alias("hub"))
    columns = ("sid", "size", "place", "label", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("sid", "size", "place", "label")))
    pairs = met.select(*columns).filter((F.col("label") != F.col("hub_label")) & _fit("", "hub_", similarity))
    pairs = pairs.select("sid", F.col("hub_sid").alias("hub")).distinct()
    others = held.filter(~F.array_contains(F.transform("hubs", lambda h: h["sid"]), F.col("sid")))
    return _verified(pairs, sets, similarity), others.select("token", "sid", "size", "own", "place")


def similar(documents: DataFrame, alive: DataFrame, similarity: float, id_col: str, text_col: str, width: int, hubs: tuple[int, ...] = HUBS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the ``sid`` of ``alive`` (``_alive`` of ``sketches``): the components of all pairs with that similarity."""
    spark, begin = documents.sparkSession, mark()
    sets = _sets(documents, alive, similarity, id_col, text_col, width)
    lead = F.posexplode(F.slice("tokens", 1, F.col("lead").cast("int"))).alias("at", "token")
    members = sets.select(lead, "sid", F.col("n").alias("size"), "own").select("token", "sid", "size", "own", (F.col("at") + F.col("own")).alias("place"))
    found: list[DataFrame] = []
    for number in (*hubs, None):
        rows, buckets = _open(members, components(reduce(DataFrame.unionByName, found)) if found else None, number or 1)
        if buckets.isEmpty():
            break
        if number is None:
            found.append(_rest(rows, buckets, sets, similarity, block))
        else:
            links_now, members = _meet(rows, buckets, sets, similarity)
            found.append(links_now)
    none = spark.createDataFrame([], "a long, b long")
    edges = materialise(reduce(DataFrame.unionByName, found, none), "simhash-links")
    sweep(spark, begin, edges)
    return edges


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, limit: int = LIMIT, similarity: float | None = 0.8) -> DataFrame:
    """One row of each component: the one whose id names it (of its rows that repeat this id, the smallest text).

    Fingerprints link within ``limit`` bits, and those of texts with the given similarity as well. Rows without
    an id cannot be named and all stay. The columns are those of ``documents``, which may have any names.
    """
    own = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"))
    rows = own.select(F.col(f"row.{id_col}").alias("id"), F.col(f"row.{text_col}").alias("text"), "row")
    texts = rows.select("id", "text")
    if similarity is None:
        prints = materialise(fingerprints(texts, "id", "text", width), "simhash")
        edges = None
    else:
        begin = mark()
        full = materialise(sketches(texts, similarity, "id", "text", width), "simhash-sketches")
        owners = materialise(full.select("id", "fp", "sid"), "simhash")
        alive = _alive(full, "id")
        del full
        sweep(documents.sparkSession, begin, owners, alive)
        prints = owners.select("id", "fp")
        firsts = owners.groupBy("sid").agg(F.min("fp").alias("first"))
        same = owners.select("sid", "fp").distinct().join(firsts, "sid").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
        pairs = similar(texts, alive, similarity, "id", "text", width)
        for end, name in (("a", "x"), ("b", "y")):
            other = "b" if end == "a" else "a"
            pairs = materialise(hot_join(pairs, firsts.select(F.col("sid").alias(end), F.col("first").alias(name)), [end], other), "simhash-ends")
        edges = same.unionByName(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = _labelled(prints, "id", limit, edges)
    named = found.filter(F.col("id") == F.col("component_id")).select("id", "fp", "root").distinct()
    copies = found.filter("id is not null").groupBy("id").agg(F.count("*").alias("copies"), F.max(F.col("id") == F.col("component_id")).alias("names"))
    ids = materialise(copies, "simhash-kept")
    gone = sieve(ids.filter("not names or copies > 1"), "id")
    rows = rows.withColumn("sieve", sieve_of(F.col("id")))
    held = rows.join(gone, "sieve", "left_semi").drop("sieve").filter("id is not null")
    kept = held.join(ids.filter("names and copies = 1"), "id", "left_semi").select("row")
    kept = kept.unionByName(rows.filter("id is not null").join(gone, "sieve", "left_anti").select("row")).unionByName(rows.filter("id is null").select("row"))
    again = ids.filter("names and copies > 1")
    if again.isEmpty():
        return kept.select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, width) for t in as_bytes(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], names=[*part.schema.names, "fp"])

    repeated = held.join(again, "id", "left_semi")
    repeated = repeated.mapInArrow(run, StructType([*repeated.schema.fields, StructField("fp", LongType())])).join(named, ["id", "fp"])
    repeated = repeated.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("text"))).filter("k = 1")
    return kept.unionByName(repeated.select("row")).select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``; fingerprints link at 2 or fewer differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
