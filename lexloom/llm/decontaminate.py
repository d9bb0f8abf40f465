"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Text is normalised to words: A-Z is lower-cased and every run of ASCII letters and digits or of non-ASCII
bytes is a word. The automaton holds all word n-grams of all items. Document words stream through it; the
state and the matched length after each word give the longest item passage that ends there.

* A *window* is ``window`` consecutive words of an item, or the whole item where that is shorter.
* A document word is *hit* if it lies inside an occurrence of a window.
* Maximal runs of hit words are spans. ``remove`` cuts every span of at least ``min_span`` words, and a
  document of which more than ``max_coverage`` of the words is hit goes as a whole. ``report`` also tells the
  longest match of each document, be it shorter than a window or not.

Cases: null text has no words; null or word-less items match nothing; repeated items count once by id; an
item without an id still hits words but is not listed; repeated rows are handled row by row; empty tables
give empty results (documents unchanged, if only the benchmark is empty).

Scale: documents are only mapped (no shuffle). Distinct items are dealt by their hash to automata of about ``max_words`` words,
which tasks build and store; so neither the driver nor a worker holds the benchmark. ``GROUP`` automata at a time
are broadcast and take one pass over the documents, in which a worker has one of them open and reads
``MANY_BYTES`` of texts before the next; with more automata than that, what a pass has found is stored and the next pass adds
to it.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import mark, materialise, slices, sweep

WINDOW = 10
MIN_SPAN = 1
MAX_COVERAGE = 0.5
MAX_WORDS = 250_000
#: Automata of one pass, and the bytes of text for which a worker opens each, where there are several.
GROUP = 4
MANY_BYTES = 32 << 20

#: Everything but [0-9a-z] after lower-casing and bytes of non-ASCII characters separates words.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, with what a window match needs at each state.

    ``next`` are the transitions, ``link`` the suffix links, ``length`` the longest string of each state.
    ``full[s]`` is the state on the link path of ``s`` that holds its last ``window`` words; ``items`` lists,
    for such states, the items that contain them. ``short[s]`` lists (length, items) of whole items under
    ``window`` words which are suffixes of the longest string of ``s``.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str | None]] = []
        shorts: list[tuple[list[bytes], str | None]] = []
        for name, words in items:
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, word)
                if n >= window:
                    ends.append((last, name))
            if 0 < len(words) < window:
                shorts.append((words, name))
        self._windows(ends)
        self._shorts(shorts)

    def _new(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state for the strings of ``q`` that also follow from ``p``; ``q`` keeps the longer ones."""
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # the passage is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _windows(self, ends: list[tuple[int, str | None]]) -> None:
        w = self.window
        self.full = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= w:
                up = self.link[s]
                self.full[s] = s if self.length[up] < w else self.full[up]
        found: dict[int, set[str]] = {}
        for s, name in ends:
            found.setdefault(self.full[s], set()).update(() if name is None else (name,))
        self.items = {s: tuple(sorted(names)) for s, names in found.items()}

    def _shorts(self, shorts: list[tuple[list[bytes], str | None]]) -> None:
        own: dict[int, dict[int, set[str]]] = {}
        for words, name in shorts:
            s = 0
            for word in words:
                s = self.next[s][word]
            own.setdefault(s, {}).setdefault(len(words), set()).update(() if name is None else (name,))
        self.short: dict[int, tuple[tuple[int, tuple[str, ...]], ...]] = {}
        for s in sorted(range(len(self.next)), key=self.length.__getitem__) if own else ():
            here = [(n, tuple(sorted(names))) for n, names in sorted(own.get(s, {}).items())]
            if more := (*self.short.get(self.link[s], ()), *here):
                self.short[s] = more

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (start, end) in order, disjoint and not touching, the names of the items found, the longest match."""
        moves, link, length, full, short, w = self.next, self.link, self.length, self.full, self.short, self.window
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        names: set[str] = set()
        state = matched = longest = 0
        root = moves[0]
        for i, word in enumerate(words, 1):
            to = moves[state].get(word)
            if to is None:
                if not state:
                    continue
                if word not in root:  # no string of the automaton ends here
                    state = matched = 0
                    continue
                while to is None:
                    state = link[state]
                    to = moves[state].get(word)
                matched = length[state]
            state = to
            matched += 1
            if matched > longest:
                longest = matched
            start = i
            if matched >= w:
                states.add(full[state])
                start = i - w
            if short and state in short:
                for n, found in short[state]:
                    if n <= matched:
                        names.update(found)
                        start = min(start, i - n)
            if start < i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        for s in states:
            names.update(self.items[s])
        return spans, names, longest


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """Stored automata, ``GROUP`` to a table (number, packed); none for a benchmark without words.

    Rows that repeat an item count once, and no table is empty, so passes follow the distinct words of the benchmark.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("text")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t or b"")) for t in part.column("text").to_pylist()], pa.int64())], names=["words"])

    total = items.mapInArrow(count, "words long").agg(F.sum("words")).first()[0] or 0
    if not total:
        return []
    parts = -(-total // max_words)

    def build(key: tuple, group: pa.Table) -> pa.Table:
        named = sorted(((name, text or b"") for name, text in zip(group.column("name").to_pylist(), group.column("text").to_pylist())), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        packed = zlib.compress(pickle.dumps(Automaton([(name, words_of(text)) for name, text in named], window)), 1)
        return pa.table({"number": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([packed], pa.binary())})

    dealt = items.withColumn("number", F.pmod(F.xxhash64("name", "text"), F.lit(parts)))
    stored = materialise(dealt.groupBy("number").applyInArrow(build, "number long, packed binary"), "automata")
    numbers = sorted(r.number for r in stored.select("number").collect())  # one for ``max_words`` words
    return [stored.filter(F.col("number").isin(numbers[at : at + GROUP])) for at in range(0, len(numbers), GROUP)]


def _merged(parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    if len(parts) == 1:
        return parts[0]
    out: list[tuple[int, int]] = []
    for start, end in sorted(s for part in parts for s in part):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_LAST: dict[str, Automaton] = {}


def _open(key: str, packed: bytes) -> Automaton:
    """The automaton of these bytes; a worker keeps only the last one it opened."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = pickle.loads(zlib.decompress(packed))
    return _LAST[key]


def _scan_all(texts: list[bytes], shared: list[tuple[str, bytes]], before: list) -> list[tuple[int, list[tuple[int, int]], set[str], int]]:
    """(words, spans, names, longest match) of each text, added to what earlier passes have found."""
    spans = [[found[0]] if found else [] for found in before]
    names = [set(found[1]) if found else set() for found in before]
    longest = [found[2] if found else 0 for found in before]
    counts = [0] * len(texts)
    for key, packed in shared:
        automaton = _open(key, packed)
        for k, text in enumerate(texts):
            words = words_of(text)
            counts[k] = len(words)
            found, who, most = automaton.scan(words)
            spans[k].append(found)
            names[k] |= who
            longest[k] = max(longest[k], most)
    if not shared:
        counts = [len(words_of(t)) for t in texts]
    return [(counts[k], _merged(spans[k]) if spans[k] else [], names[k], longest[k]) for k in range(len(texts))]


def _large(batches: Iterator[pa.RecordBatch], text_col: str, several: bool) -> Iterator[pa.RecordBatch]:
    """Slices of 256 rows; where several automata are to be opened, ``MANY_BYTES`` of text or the last rows."""
    if not several:
        yield from slices(batches, 256)
        return
    held, size = [], 0
    for part in slices(batches, 256):
        held.append(part)
        size += part.column(text_col).nbytes
        if size >= MANY_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _scanned(rows: DataFrame, benchmark: DataFrame, window: int, max_words: int):
    """``rows`` (row, text, found) after all passes but the last, and the automata of the last one."""
    spark = rows.sparkSession
    groups = automata(benchmark, window, max_words)
    rows = rows.withColumn("found", F.lit(None).cast("binary"))
    opened = lambda group: [(uuid.uuid4().hex, bytes(r.packed)) for r in group.collect()] if group else []  # noqa: E731  ``GROUP`` rows
    start = None
    for group in groups[:-1]:
        shared = spark.sparkContext.broadcast(opened(group))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in _large(batches, "text", True):
                before = [None if f is None else pickle.loads(f) for f in part.column("found").to_pylist()]
                found = _scan_all([t or b"" for t in part.column("text").to_pylist()], shared.value, before)
                yield part.set_column(part.schema.get_field_index("found"), "found", pa.array([pickle.dumps(x[1:]) for x in found], pa.binary()))

        begin, rows = mark(), materialise(rows.mapInArrow(run, rows.schema), "decontaminate")
        if start is not None:
            sweep(spark, start, rows)
        start = begin
        shared.unpersist()
    return rows, spark.sparkContext.broadcast(opened(groups[-1] if groups else None))


def word_edges(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets (start, end) of the words."""
    flat = text.translate(_NORMAL)
    out, at = [], 0
    for word in flat.split():
        at = flat.index(word, at)
        out.append((at, at + len(word)))
        at += len(word)
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what lies between them."""
    edges = word_edges(text)
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at : edges[start][0]])
        at = edges[end - 1][1]
    return b"".join((*parts, text[at:]))


REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, coverage double, longest_span long, longest_match long, remove_document boolean"


def report(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """One row for each document: what of it is in the benchmark, and whether it should go as a whole."""
    rows, shared = _scanned(documents.select(F.col(id_col).alias("row"), F.col(text_col).cast("binary").alias("text")), benchmark, window, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _large(batches, "text", len(shared.value) > 1):
            before = [None if f is None else pickle.loads(f) for f in part.column("found").to_pylist()]
            found = _scan_all([t or b"" for t in part.column("text").to_pylist()], shared.value, before)
            hit = [sum(e - s for s, e in spans) for _, spans, _, _ in found]
            cover = [h / n if n else 0.0 for h, (n, _, _, _) in zip(hit, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([n for n, _, _, _ in found], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(names) for _, _, names, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(names)).encode()).hexdigest() for _, _, names, _ in found], pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                    pa.array(cover, pa.float64()),
                    pa.array([max((e - s for s, e in spans), default=0) for _, spans, _, _ in found], pa.int64()),
                    pa.array([most for _, _, _, most in found], pa.int64()),
                    pa.array([c > max_coverage for c in cover], pa.bool_()),
                ],
                names=[id_col, *(x.split()[0] for x in REPORT.split(", "))],
            )

    return rows.mapInArrow(run, f"{id_col} {rows.schema['row'].dataType.simpleString()}, {REPORT}")


def remove(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """``documents`` with the same columns, without contaminated spans and without covered documents.

    Spans shorter than ``min_span`` words stay.
    """
    others = [c for c in documents.columns if c != text_col]
    row = F.struct(*(documents[c] for c in others)).alias("row") if others else F.lit(True).alias("row")
    rows, shared = _scanned(documents.select(row, documents[text_col].cast("binary").alias("text")), benchmark, window, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _large(batches, "text", len(shared.value) > 1):
            raw = part.column("text").to_pylist()
            before = [None if f is None else pickle.loads(f) for f in part.column("found").to_pylist()]
            keep, texts = [], []
            for text, (n, spans, _, _) in zip(raw, _scan_all([t or b"" for t in raw], shared.value, before)):
                hit = sum(e - s for s, e in spans)
                keep.append(not n or hit <= max_coverage * n)
                spans = [s for s in spans if s[1] - s[0] >= min_span]
                texts.append(cut(text, spans) if spans and keep[-1] else text)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.binary())], names=["row", "text"]).filter(pa.array(keep, pa.bool_()))

    out = rows.mapInArrow(run, rows.select("row", "text").schema)
    kind = documents.schema[text_col].dataType
    return out.select(*(F.col("text").cast(kind).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in documents.columns))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` against every item of ``benchmark``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
