"""Toxicity with a weighted finite-state pattern grammar.

Words are read by a lexicon, and clauses by one machine that is composed of four transducers (``compose``). The
lexicon turns a word into one or more weighted symbols:

* ``insult``, by a prefix tree over word beginnings and whole words: the weight of the best match;
* ``harm``, a word that is toxic only where somebody is addressed: the weight of the best match;
* ``target`` (a person addressed or spoken of), ``negation``, ``report`` (a verb of saying, an opening quote);
* ``word``, anything else, with no weight.

The transducers copy symbols and scale their weights:

* *negation*: insults and harm in the ``SPAN`` tokens after a negation count ``NEGATED`` as much;
* *reported speech*: what follows a report in the clause counts ``REPORTED`` as much;
* *target*: two paths, one that finds a target somewhere in the clause and raises insults by ``BOOST``, and one without;
* *threat*: harm counts only on a path that has met a target or still has to meet one in the clause.

The composed machine is nondeterministic; the weight of a clause is that of its best path (``Machine.best``), so what is
scored is a whole matched clause, not a word. A text's features are its best clause, the log of the sum over clauses, and
the share of its clauses that match; a logistic function, fitted on labelled rows, turns them into a score
between 0 and 1. For this fit each half of the rows is read with the lexicon of the other half, so words known
from a single row don't count as evidence.

The weights of insults are log-odds of their stems among labelled rows, lowered by their uncertainty; those of harm are the
same for words in clauses with a target, where they exceed what the word weighs elsewhere. Short lists of English
words give both a floor where no labels exist. Stems need a least weight. Which of ``LEAST_WEIGHTS`` is decided by
the loss of the fit: few rows need weak stems, many rows have strong ones and enough weak ones by chance to mislead.

Learning uses at most about ``train_rows`` labelled rows (a hash-chosen share, all where there are fewer),
which bounds the broadcast of their ids and the lexicon, and the fit at most about ``fit_rows`` of them (five numbers each).
Word counts of these rows are summed in the cluster; stems that pass ``MIN_DOCS`` and the least weight go to the
driver. Scoring maps over whole texts without a shuffle.

Cases: null text is empty and gets the score of a text without matches; labels that are null or belong to no
document are left out; without any usable label fixed weights apply; repeated rows give repeated rows; a
label given twice counts once by its highest value; equal weights are no tie, as all stems are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, slices

TRAIN_ROWS = 200_000
MIN_DOCS = 5
FIT_ROWS = 20_000
LEAST_WEIGHTS = (1.0, 2.0, 3.0)
STEM = (3, 8)
THRESHOLD = 0.3

#: Floors of the insults and the harm, and the fixed word classes.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown", "bastard", "bitch", "asshole", "retard")
THREATS = ("kill", "murder", "hurt", "destroy", "burn", "beat", "strangle", "shoot", "stab", "die", "rape", "hang")
TARGETS = ("you", "your", "yours", "u", "ur", "he", "she", "they", "them", "him", "her", "everyone", "people", "these", "those", "all")
NEGATIONS = ("not", "no", "never", "isn", "aren", "wasn", "don", "doesn", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "told", "wrote", "quoted", "claimed", "called", "according", "reported", "allegedly")
FLOOR = 2.0
BOOST, NEGATED, REPORTED, THREAT, SPAN = 1.25, 0.5, 0.6, 3.0, 3
#: How much more a stem must weigh beside a target to be harm.
AIMED_GAIN = 1.0

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"""[^\W\d_]+|[.!?;:\n|]|["“„«]""")
_END = frozenset(".!?;:\n|")
_FIXED = {
    **{w: "target" for w in TARGETS},
    **{w: "negation" for w in NEGATIONS},
    **{w: "report" for w in REPORTS},
    **{w: "report" for w in '"“„«'},
}
SYMBOLS = ("word", "insult", "harm", "target", "negation", "report")
#: Before a word in the counts: it stood in a clause with a target.
_AIMED = "\x01"


@dataclass(frozen=True)
class Transducer:
    """``arcs[state, symbol]`` lists (next state, symbol given off, scale); a path ends in one of ``finals``."""

    arcs: dict
    start: object
    finals: frozenset


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``a`` gives off, read by ``b``: states are pairs, scales multiply."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        p, q = todo.pop()
        for symbol in SYMBOLS:
            found = [((to, to_b), out_b, w * v) for to, out, w in a.arcs.get((p, symbol), ()) for to_b, out_b, v in b.arcs.get((q, out), ())]
            if found:
                arcs[(p, q), symbol] = found
                new = {to for to, _, _ in found} - seen
                seen |= new
                todo += new
    return Transducer(arcs, start, frozenset(s for s in seen if s[0] in a.finals and s[1] in b.finals))


def negation(span: int = SPAN, scale: float = NEGATED) -> Transducer:
    """States: how many tokens a negation still reaches."""
    arcs = {}
    for left in range(span + 1):
        for symbol in SYMBOLS:
            weighed = scale if left and symbol in ("insult", "harm") else 1.0
            arcs[left, symbol] = [(span if symbol == "negation" else max(0, left - 1), symbol, weighed)]
    return Transducer(arcs, 0, frozenset(range(span + 1)))


def reported(scale: float = REPORTED) -> Transducer:
    arcs = {}
    for state in (False, True):
        for symbol in SYMBOLS:
            arcs[state, symbol] = [(state or symbol == "report", symbol, scale if state and symbol in ("insult", "harm") else 1.0)]
    return Transducer(arcs, False, frozenset((False, True)))


def target(boost: float = BOOST) -> Transducer:
    """``plain`` ends anywhere; ``aiming`` has raised insults and must meet a target, ``aimed`` has met one."""
    arcs = {}
    for symbol in SYMBOLS:
        raised = boost if symbol == "insult" else 1.0
        met = "aimed" if symbol == "target" else "aiming"
        arcs["begin", symbol] = [("plain", symbol, 1.0), (met, symbol, raised)]
        arcs["plain", symbol] = [("plain", symbol, 1.0)]
        arcs["aiming", symbol] = [(met, symbol, raised)]
        arcs["aimed", symbol] = [("aimed", symbol, raised)]
    return Transducer(arcs, "begin", frozenset(("begin", "plain", "aimed")))


def threat() -> Transducer:
    """``idle`` has counted no harm, ``owing`` has counted some before a target, ``met`` has a target."""
    arcs = {}
    for symbol in SYMBOLS:
        arcs["idle", symbol] = [("met" if symbol == "target" else "idle", symbol, 0.0 if symbol == "harm" else 1.0)]
        arcs["owing", symbol] = [("met" if symbol == "target" else "owing", symbol, 1.0)]
        arcs["met", symbol] = [("met", symbol, 1.0)]
    arcs["idle", "harm"].append(("owing", "harm", 1.0))
    return Transducer(arcs, "idle", frozenset(("idle", "met")))


class Machine:
    """A transducer with numbered states, and the weight of a clause by its best path."""

    def __init__(self, of: Transducer):
        names = {s: k for k, s in enumerate(dict.fromkeys([of.start, *(to for arcs in of.arcs.values() for to, _, _ in arcs)]))}
        self.start = names[of.start]
        self.finals = frozenset(names[s] for s in of.finals)
        self.arcs = [{x: tuple((names[to], scale) for to, _, scale in of.arcs.get((s, x), ())) for x in SYMBOLS} for s in names]

    def best(self, clause: list[tuple[tuple[str, float], ...]]) -> float:
        """``clause`` has for each token its symbols with their weights."""
        now = {self.start: 0.0}
        for options in clause:
            following: dict[int, float] = {}
            for state, so_far in now.items():
                arcs = self.arcs[state]
                for symbol, weight in options:
                    for to, scale in arcs[symbol]:
                        total = so_far + scale * weight
                        if total > following.get(to, -1.0):
                            following[to] = total
            now = following
        return max((w for s, w in now.items() if s in self.finals), default=0.0)


#: Lexicon, negation, reported speech, target and threat in a row.
GRAMMAR = compose(compose(compose(negation(), reported()), target()), threat())
_MACHINE = Machine(GRAMMAR)


@dataclass
class Grammar:
    """The weights of insults and harm (a stem, or a whole word with ``$`` at its end) and the logistic function."""

    stems: dict[str, float] = field(default_factory=dict)
    harms: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (-4.0, 1.0, 1.0, 0.0)
    _memo: dict[str, tuple] = field(default_factory=dict, repr=False)

    @staticmethod
    def _weight(table: dict[str, float], word: str) -> float:
        get = table.get
        return max([get(word + "$", 0.0), *(get(word[:n], 0.0) for n in range(STEM[0], min(STEM[1], len(word)) + 1))])

    def symbols(self, word: str) -> tuple[tuple[str, float], ...]:
        """The symbols of a word and their weights."""
        found = self._memo.get(word)
        if found is None:
            insult = max(self._weight(self.stems, word), FLOOR if word in INSULTS else 0.0)
            harm = max(self._weight(self.harms, word), THREAT if word in THREATS else 0.0)
            found = tuple((s, w) for s, w in (("insult", insult), ("harm", harm)) if w > 0)
            if kind := _FIXED.get(word):
                found = (*found, (kind, 0.0))
            found = found or (("word", 0.0),)
            if len(self._memo) > 500_000:
                self._memo.clear()
            self._memo[word] = found
        return found

    def features(self, text: str) -> tuple[float, float, float]:
        """Best clause, log of one plus the sum of the clauses, share of the clauses that match."""
        low = text.lower()
        known, symbols = self._memo.get, self.symbols
        if not any((known(w) or symbols(w))[0][1] for w in set(_WORD.findall(low))):
            return 0.0, 0.0, 0.0
        clauses = matched = 0
        best = total = 0.0
        clause: list[tuple] = []
        weighty = False
        for token in (*_TOKEN.findall(low), "."):
            if token in _END:
                if clause:
                    clauses += 1
                    weight = _MACHINE.best(clause) if weighty else 0.0
                    if weight:
                        matched += 1
                        total += weight
                        best = max(best, weight)
                    clause, weighty = [], False
                continue
            found = known(token) or symbols(token)
            clause.append(found)
            if found[0][1]:
                weighty = True
        return best, float(np.log1p(total)), matched / clauses if clauses else 0.0

    def score(self, features: tuple[float, float, float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))


def _words(text: str) -> set[str]:
    """The words of a text, and once more, marked, those of clauses with a target."""
    low = text.lower()
    words = set(_WORD.findall(low))
    if words.isdisjoint(TARGETS):
        return words
    for clause in re.split(r"[.!?;:\n|]", low):
        own = set(_WORD.findall(clause))
        if not own.isdisjoint(TARGETS):
            words.update(_AIMED + w for w in own)
    return words


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c00, c01, c10, c11): documents with the word, by half and label, summed within a task."""
    counts = {key: Counter() for key in ((0, 0), (0, 1), (1, 0), (1, 1))}

    def out() -> pa.RecordBatch:
        words = list(set().union(*counts.values()))
        columns = [pa.array([counts[key][w] for w in words], pa.int64()) for key in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], names=["word", "c00", "c01", "c10", "c11"])

    for part in slices(batches):
        for text, half, label in zip(*(part.column(n).to_pylist() for n in ("text", "half", "label"))):
            counts[half, label].update(_words(text or ""))
        if sum(map(len, counts.values())) > 500_000:
            yield out()
            for c in counts.values():
                c.clear()
    if any(counts.values()):
        yield out()


def _stems(counts: DataFrame, sums: dict[str, float], clean: tuple[str, ...], toxic: tuple[str, ...]) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of the stems in the given halves, lowered by 1.64 times their standard error, if over 1.

    Insults, and harm: stems that weigh more in clauses with a target than anywhere.
    """
    t, c = sum((F.col(x) for x in toxic), F.lit(0)), sum((F.col(x) for x in clean), F.lit(0))
    all_t, all_c = sum(sums[x] for x in toxic) + 1, sum(sums[x] for x in clean) + 1
    rows = counts.select("stem", t.alias("t"), c.alias("c")).filter(F.col("t") >= MIN_DOCS)
    odds = F.log((F.col("t") + 0.5) / F.lit(all_t)) - F.log((F.col("c") + 0.5) / F.lit(all_c))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rows = rows.select("stem", (odds - 1.64 * error).alias("w")).filter("w > 1")
    found = {stem: w for stem, w in rows.collect()}  # stems of a bounded sample of rows
    insults = {stem: w for stem, w in found.items() if not stem.startswith(_AIMED)}
    return insults, {stem[1:]: w for stem, w in found.items() if stem.startswith(_AIMED) and w > insults.get(stem[1:], 0.0) + AIMED_GAIN}


def _over(lexicon: tuple[dict[str, float], dict[str, float]], least: float) -> tuple[dict[str, float], dict[str, float]]:
    insults, harms = lexicon
    return {stem: w for stem, w in insults.items() if w > least}, {stem: w for stem, w in harms.items() if w > least}


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """Ridge logistic regression by Newton steps, with a free intercept: the loss and the weights."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    z = np.clip(x @ beta, -30, 30)
    return float(np.logaddexp(0, z).sum() - (y * z).sum()), tuple(float(b) for b in beta)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, fit_rows: int = FIT_ROWS) -> Grammar:
    """Learn a grammar from the labelled rows given."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    known = rows.count()
    side = F.xxhash64("id")
    if known > train_rows:
        rows = rows.filter(F.pmod(F.shiftright(side, 16), F.lit(1 << 20)) < int((1 << 20) * train_rows / known))
    rows = rows.withColumn("half", F.pmod(side, F.lit(2)).cast("int"))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id").select("text", "half", "label", side.alias("side"))
    counts = materialise(texts.select("text", "half", "label").mapInArrow(_word_counts, "word string, c00 long, c01 long, c10 long, c11 long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11"))), "tox-words")
    names = ("c00", "c01", "c10", "c11")
    sums = {n: float(v or 0) for n, v in zip(names, counts.filter(~F.startswith("word", F.lit(_AIMED))).agg(*(F.sum(n) for n in names)).first())}
    if not (sums["c00"] + sums["c10"]) or not (sums["c01"] + sums["c11"]):
        return Grammar()
    skip = F.startswith("word", F.lit(_AIMED)).cast("int")  # the marker is no letter
    sizes = F.sequence(skip + STEM[0], F.greatest(skip + STEM[0], F.least(skip + STEM[1], F.length("word"))))
    prefixes = F.when(F.length("word") >= skip + STEM[0], F.transform(sizes, lambda n: F.substring(F.col("word"), F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    stems = counts.select(F.explode(F.concat(prefixes, F.array(F.concat("word", F.lit("$"))))).alias("stem"), *names)
    stems = materialise(stems.groupBy("stem").agg(*(F.sum(n).alias(n) for n in names)).filter(F.col("c01") + F.col("c11") >= MIN_DOCS), "tox-stems")
    halves = [_stems(stems, sums, (f"c{h}0",), (f"c{h}1",)) for h in (0, 1)]
    full = _stems(stems, sums, ("c00", "c10"), ("c01", "c11"))
    other = documents.sparkSession.sparkContext.broadcast(halves)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = [[Grammar(*_over(s, least)) for s in other.value] for least in LEAST_WEIGHTS]
        for part in slices(batches):
            rows = list(zip(*(part.column(n).to_pylist() for n in ("text", "half", "label"))))
            found = [(float(k), *pair[1 - half].features(text or ""), float(label)) for k, pair in enumerate(grammars) for text, half, label in rows]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()) for v in zip(*found)], names=["k", "best", "total", "share", "label"])

    share = min(1.0, fit_rows / max(1, min(known, train_rows)))
    some = texts.filter(F.pmod(F.shiftright("side", 40), F.lit(1 << 20)) < int((1 << 20) * share))
    data = some.select("text", "half", "label").mapInArrow(read, "k double, best double, total double, share double, label double")
    # equal rows are counted in the cluster; sums over them are what the fit needs
    grouped = data.groupBy("k", *(F.round(c, 2).alias(c) for c in ("best", "total", "share")), "label").count().orderBy("k", "best", "total", "share", "label").collect()
    table = np.array([tuple(r) for r in grouped], float).reshape(-1, 6)
    fits = []
    for k, least in enumerate(LEAST_WEIGHTS):
        own = table[table[:, 0] == k]
        n = own[:, 5].astype(int)
        fits.append((*_logistic(np.repeat(own[:, 1:4], n, axis=0), np.repeat(own[:, 4], n)), least))
    _, weights, least = min(fits)
    return Grammar(*_over(full, least), weights)


def score(documents: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, best_clause, matched_share) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast((grammar.stems, grammar.harms, grammar.weights))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value)
        for part in slices(batches):
            found = [own.features(t or "") for t in part.column("text").to_pylist()]
            scores = [own.score(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.float64()),
                ],
                names=[id_col, "score", "predicted", "best_clause", "matched_share"],
            )

    schema = f"{id_col} {kind}, score double, predicted int, best_clause double, matched_share double"
    return documents.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col, folds: int, fold: int):
    """True where crc32 of the id as text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; labels only from rows that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    grammar = fit(docs, labels.filter(~held_out("doc_id", 4, 2)))
    found = score(docs, grammar)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "best_clause", "matched_share")
