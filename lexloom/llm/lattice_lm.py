"""Document likelihood over a subword lattice, beside an add-half word unigram.

Event space: A-Z is lower-cased, a text is its sequence of words (runs of bytes other than space and \\t-\\r)
and one end. A word is spelled by the pieces of an existing subword vocabulary with "\\u2581" before its first
character; pieces hold that mark only at their beginning, so the lattice of a text is the product of the
lattices of its words. The marginal probability of a word is the sum over *all* its segmentations, by the
forward recursion alpha[j] = logsumexp over pieces w[i:j] of alpha[i] + log p(piece), in log space; bytes are
pieces too (fallback), so every word has a spelling. A piece has a probability as first and as later piece,
and one of ending the word, so the probabilities of all words sum to one. (The byte strings that are no text
keep the little mass that bytes give them.)

The vocabulary and its ids come from a file and are never changed. Its own scores are where the piece probabilities
start: log probabilities as they are, merge ranks as 1 / (1 + rank). ``ROUNDS`` rounds of expectation maximisation
follow: forward and backward recursions over the lattices of all training words, weighted by their counts, give the
expected use of every piece, and these are the next probabilities, with ``FLOOR`` of a use added.
With ``word_arcs`` a word met in training is one more arc of its lattice: its count less an absolute
discount D = n1 / (n1 + 2 n2) goes to this arc, and what all discounts take away goes to the spelled segmentations.

Plan: each task turns batches of documents into a *block*: its distinct words with counts in training texts,
and each document's bag of words as indices into them. Blocks are written once. The words of all blocks
are summed (this is what is gathered from the corpus; it grows with it), scored once for each distinct
word, and joined back to (block, word); a block and its words then give all sums of its documents. Only
expected uses of pieces (bounded by the vocabulary) and totals reach the driver. A word costs a block one row, however
often it occurs; a block is bounded by ``block_bytes`` of text or one document. Lattices of many words of one length
are computed together, as arrays.

Cases: null text is empty (one token, the end); null ids are training rows, ids may be of any type; repeated rows
are rows; with an empty training set the vocabulary's scores decide; words of any length are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import LOWER, as_bytes, mark, materialise, slices, sweep
from .toxicity import held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 24 << 20
MARK = "▁"
ROUNDS = 3
FLOOR = 0.01
#: Words whose lattices are computed together.
WORDS_AT_ONCE = 50_000
#: Cells (word, place) of one array.
CELLS = 1 << 18

_BLOCK = "block long, words array<string>, train array<long>, ids array<{}>, held array<boolean>, ends array<long>, word_at binary, word_n binary"


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    index: dict[bytes, int] = {}
    train: list[int] = []
    ids: list = []
    held: list[bool] = []
    ends, at, n, size = [0], [], [], 0
    kind = pa.int64()

    def out() -> pa.RecordBatch:
        values = [
            pa.array([number], pa.int64()),
            pa.array([list(index)], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            pa.array([train], pa.list_(pa.int64())),
            pa.array([ids], pa.list_(kind)),
            pa.array([held], pa.list_(pa.bool_())),
            pa.array([ends], pa.list_(pa.int64())),
            pa.array([np.concatenate([np.empty(0, np.int32), *at]).tobytes()], pa.binary()),
            pa.array([np.concatenate([np.empty(0, np.int32), *n]).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(values, names=["block", "words", "train", "ids", "held", "ends", "word_at", "word_n"])

    for part in slices(batches):
        kind = part.schema.field("id").type
        for doc, out_of, text in zip(part.column("id").to_pylist(), part.column("held").to_pylist(), as_bytes(part.column("text"))):
            bag = Counter(text.translate(LOWER).split())
            where = np.empty(len(bag), np.int32)
            for k, word in enumerate(bag):
                i = index.get(word)
                if i is None:
                    i = index[word] = len(train)
                    train.append(0)
                where[k] = i
                if not out_of:
                    train[i] += bag[word]
            at.append(where)
            n.append(np.fromiter(bag.values(), np.int32, len(bag)))
            ends.append(ends[-1] + len(bag))
            ids.append(doc)
            held.append(out_of)
            size += len(text) + 64
            if size >= block_bytes:
                yield out()
                number += 1
                index, train, ids, held, ends, at, n, size = {}, [], [], [], [0], [], [], 0
    if ids:
        yield out()


def read_vocabulary(path: str) -> tuple[list[str], list[float]]:
    """The pieces of a SentencePiece model and their scores, by id; the path is a parameter, nothing of it is kept here."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each code point."""
    with np.errstate(over="ignore"):
        z = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(32))


def _prefixes(points: np.ndarray) -> np.ndarray:
    """[row, n]: rolling hashes of the first n code points of each row."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    mixed = _mixed(points)
    with np.errstate(over="ignore"):
        for j in range(points.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + mixed[:, j]
    return out


class Pieces:
    """The usable pieces of a vocabulary, and the places in words that they match.

    Row k of the parameters belongs to piece k; the last row is one byte (any of 256).
    """

    def __init__(self, pieces: list[str], scores: list[float]):
        usable = {}
        for piece, score in zip(pieces, scores):
            special = not piece or piece in ("<unk>", "<s>", "</s>") or (len(piece) == 6 and piece.startswith("<0x"))
            if not special and MARK not in piece[1:]:
                usable[piece] = max(score, usable.get(piece, score))
        usable.setdefault(MARK, min(usable.values(), default=-1.0))
        self.names = list(usable)
        self.first = np.array([p.startswith(MARK) for p in self.names] + [False])
        self.mark = self.names.index(MARK)
        ranks = any(s < -100 for s in usable.values())  # merge ranks, not log probabilities
        self.start = np.array([1 / (1 - s) if ranks else math.exp(s) for s in usable.values()])
        self.longest = max(map(len, self.names))
        hashes = np.array([_prefixes(np.array([[ord(c) for c in p]], np.uint32))[0, -1] for p in self.names], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.sizes = np.array([len(p) for p in self.names])
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]), dtype=np.uint64)

    def matches(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length d from 1: [row, start] the piece of d code points there, or -1."""
        prefixes, found = _prefixes(points), []
        for d in range(1, min(self.longest, points.shape[1]) + 1):
            with np.errstate(over="ignore"):
                own = prefixes[:, d:] - prefixes[:, :-d] * self.powers[d]
            at = np.searchsorted(self.hashes, own)
            at[at == len(self.hashes)] = 0
            piece = np.where(self.hashes[at] == own, self.order[at], -1)
            wrong = self.first[piece]  # pieces with the mark begin a word, others don't
            wrong[:, 0] = ~wrong[:, 0]
            piece[wrong | (self.sizes[np.minimum(piece, len(self.sizes) - 1)] != d)] = -1
            found.append(piece)
        return found


def _sum_log(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    all_of = np.stack(terms)
    top = all_of.max(axis=0)
    safe = np.where(np.isneginf(top), 0.0, top)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(all_of - safe).sum(axis=0))


class Lattice:
    """Log marginal probabilities of words: ``go[k]`` and ``end[k]`` are the logs of piece k with the word going on or ending."""

    def __init__(self, pieces: Pieces, go: np.ndarray, end: np.ndarray):
        self.pieces, self.go, self.end = pieces, go, end

    def _weights(self, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """The pieces by length and place, the logs of these arcs, and length and log of each character as bytes."""
        ids = self.pieces.matches(points)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        logs = []
        for d, piece in enumerate(ids, 1):
            log = np.where(piece >= 0, self.go[piece], -np.inf)
            log[:, -1] = np.where(piece[:, -1] >= 0, self.end[piece[:, -1]], -np.inf)
            logs.append(log)
        spelled = size * self.go[-1]
        spelled[:, -1] += self.end[-1] - self.go[-1]
        spelled[:, 0] = -np.inf  # the mark is no text: it comes as a piece or in one
        return ids, logs, size, spelled

    @staticmethod
    def _forward(logs: list[np.ndarray], spelled: np.ndarray) -> np.ndarray:
        rows, places = spelled.shape
        alpha = np.full((rows, places + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, places + 1):
            terms = [alpha[:, j - d] + logs[d - 1][:, j - d] for d in range(1, min(len(logs), j) + 1)]
            alpha[:, j] = _sum_log([*terms, alpha[:, j - 1] + spelled[:, j - 1]])
        return alpha

    def batch(self, points: np.ndarray) -> np.ndarray:
        """Natural logs for words of one length, given as code points with the mark."""
        _, logs, _, spelled = self._weights(points)
        return self._forward(logs, spelled)[:, -1]

    def expect(self, points: np.ndarray, counts: np.ndarray, uses: np.ndarray, lasts: np.ndarray) -> None:
        """Add the expected uses of pieces, and of pieces as last ones, in words that occur ``counts`` times."""
        ids, logs, size, spelled = self._weights(points)
        alpha = self._forward(logs, spelled)
        places = points.shape[1]
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0.0
        for i in range(places - 1, -1, -1):
            terms = [logs[d - 1][:, i] + beta[:, i + d] for d in range(1, min(len(logs), places - i) + 1)]
            beta[:, i] = _sum_log([*terms, spelled[:, i] + beta[:, i + 1]])
        total, weight = alpha[:, -1:], counts[:, None]
        for d, (piece, log) in enumerate(zip(ids, logs), 1):
            here = piece >= 0
            share = np.where(here, np.exp(alpha[:, : places + 1 - d] + log + beta[:, d:] - total) * weight, 0.0)
            uses += np.bincount(piece[here], share[here], len(uses))
            lasts += np.bincount(piece[:, -1][here[:, -1]], share[:, -1][here[:, -1]], len(lasts))
        share = np.exp(alpha[:, :-1] + spelled + beta[:, 1:] - total) * weight
        uses[-1] += (share * size).sum()
        lasts[-1] += share[:, -1].sum()


def probabilities(pieces: Pieces, uses: np.ndarray | None = None, lasts: np.ndarray | None = None) -> Lattice:
    """The lattice of the vocabulary's own scores, or of the expected uses of its pieces."""
    byte = len(pieces.names)
    if uses is None:
        uses, lasts = np.append(pieces.start, 0.0), np.append(pieces.start, 0.0) * 0.3
    mass = uses + FLOOR
    mass[byte] = uses[byte] + 256 * FLOOR
    share = np.where(pieces.first, mass / mass[pieces.first].sum(), mass / mass[~pieces.first].sum())
    share[byte] /= 256
    common = (lasts.sum() + 1) / (uses.sum() + 2)
    ends = (lasts + 2 * common) / (uses + 2)
    ends[pieces.mark] = 0.0  # the mark alone is no word
    with np.errstate(divide="ignore"):
        return Lattice(pieces, np.log(share) + np.log1p(-ends), np.log(share) + np.log(ends))


def _same_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their code points with the mark) for groups of words of one length."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1):
        size = int(sizes[group[0]])
        step = max(1, CELLS // (size + 1))
        for lo in range(0, len(group), step):
            which = group[lo : lo + step]
            points = np.empty((len(which), size + 1), np.uint32)
            points[:, 0] = ord(MARK)
            points[:, 1:] = flat[starts[which][:, None] + np.arange(size)]
            yield which, points


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words and counts, ``WORDS_AT_ONCE`` or the last ones."""
    words: list[str] = []
    counts: list[np.ndarray] = []
    for part in batches:
        words += part.column("word").to_pylist()
        counts.append(part.column("c").to_numpy(zero_copy_only=False))
        if len(words) >= WORDS_AT_ONCE:
            yield words, np.concatenate(counts)
            words, counts = [], []
    if words:
        yield words, np.concatenate(counts)


def learn(words: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> Lattice:
    """Piece probabilities by expectation maximisation over (word, c): all words, as often as they occur."""
    pieces = Pieces(*read_vocabulary(vocabulary))
    lattice = probabilities(pieces)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((pieces, lattice.go, lattice.end))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Lattice(*shared.value)
            uses, lasts = np.zeros(len(own.go)), np.zeros(len(own.go))
            for some, counts in _many(batches):
                for which, points in _same_length(some):
                    own.expect(points, counts[which].astype(float), uses, lasts)
            found = np.nonzero(uses)[0]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(uses[found]), pa.array(lasts[found])], names=["piece", "uses", "lasts"])

        sums = words.mapInArrow(run, "piece long, uses double, lasts double").groupBy("piece").agg(F.sum("uses"), F.sum("lasts"))
        uses, lasts = np.zeros(len(lattice.go)), np.zeros(len(lattice.go))
        for piece, use, last in sums.collect():  # one row a piece of the vocabulary
            uses[piece], lasts[piece] = use, last
        if not uses.any():
            break
        lattice = probabilities(pieces, uses, lasts)
    return lattice


def likelihood(documents: DataFrame, held_col, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, word_arcs: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"), held_col.alias("held"), F.col(text_col).alias("text"))
    blocks = materialise(docs.mapInArrow(lambda it: _blocks(it, block_bytes), _BLOCK.format(kind)), "lm-blocks")
    words = blocks.select(F.explode(F.arrays_zip("words", "train")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.train").alias("c"))
    words = materialise(words, "lm-words")
    sweep(spark, mark())  # the shuffle that counted them may go
    known = words.filter("c > 0")
    in_words, kinds, once, twice = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = blocks.agg(F.sum(F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + F.when(h, 0).otherwise(1)))).first()[0] or 0
    tokens = in_words + ends
    lattice = learn(known.select("word", "c"), vocabulary, rounds)
    shared = spark.sparkContext.broadcast((lattice.pieces, lattice.go, lattice.end))
    floor = tokens + 0.5 * (kinds + (ends > 0) + 1)
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    spelled = discount * kinds / in_words if in_words and word_arcs else 1.0  # what the discounts leave to spelling
    end_p = (ends + 0.5) / (tokens + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log10 of each word's marginal over its spellings, and its own arc where words have arcs."""
        own = Lattice(*shared.value)
        for some, c in _many(batches):
            log_p = np.empty(len(some))
            for which, points in _same_length(some):
                log_p[which] = own.batch(points)
            if word_arcs:
                with np.errstate(divide="ignore"):
                    log_p = np.logaddexp(np.log(np.maximum(c - discount, 0) / max(in_words, 1)), log_p + math.log(spelled))
            score = (log_p + math.log1p(-end_p)) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(c, pa.int64()), pa.array(score)], names=["word", "c", "logp"])

    scored = words.mapInArrow(weigh, "word string, c long, logp double")
    pairs = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word")).join(scored, "word").select("of", "at", "c", "logp")
    end_base, end_known = math.log10((ends + 0.5) / floor), ends > 0

    def total(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums for the documents of one block; ``right`` is empty only if none of them has a word."""
        at = right.column("at").to_numpy()
        c, logp = np.zeros(len(at), np.int64), np.zeros(len(at))
        c[at], logp[at] = right.column("c").to_numpy(), right.column("logp").to_numpy()
        base = np.log10((c + 0.5) / floor)
        row = {n: left.column(n)[0] for n in left.column_names}
        edges = np.array(row["ends"].as_py(), np.int64)
        where, n = np.frombuffer(row["word_at"].as_py(), np.int32), np.frombuffer(row["word_n"].as_py(), np.int32)
        over = lambda v: np.diff(np.concatenate([[0], np.cumsum(v * n)])[edges])
        exact = lambda v: np.array([math.fsum(part) for part in np.split(v * n, edges[1:-1])])
        docs_n = len(edges) - 1
        return pa.table(
            {
                "id": row["ids"].values,
                "held_out": row["held"].values,
                "n_tokens": over(np.ones(len(n), np.int64)) + 1,
                "n_known": over((c > 0)[where].astype(np.int64)) + int(end_known),
                "train_tokens": np.full(docs_n, tokens, np.int64),
                "base_score": exact(base[where]) + end_base,
                "score": exact(logp[where]) + math.log10(end_p),
            }
        )

    schema = T._parse_datatype_string(f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    # partitions follow the number of blocks, so that a task holds few of them at any size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // 4))
    left = blocks.select("block", "ids", "held", "ends", "word_at", "word_n").repartition(tasks, "block")
    done = left.groupBy("block").cogroup(pairs.repartition(tasks, "of").groupBy("of")).applyInArrow(total, schema)
    return done.withColumnRenamed("id", id_col)


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; rows with crc32(doc_id) mod 5 = 1 are held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return likelihood(docs, held_out("doc_id", 5, 1))
