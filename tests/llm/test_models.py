"""The lattice against sums over all segmentations, and held-out results of the learned operators."""

import functools
import itertools
import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import lattice_lm, toxicity

from . import brute


TOY = ["<unk>", "<s>", "</s>", "<0x41>", "\u2581", "\u2581a", "\u2581ab", "a", "b", "ba", "bab", "a\u2581"]


def toy(byte_floor=None):
    pieces = lattice_lm.Pieces(TOY, [-1.0 - 0.1 * k for k in range(len(TOY))])
    uses, lasts = np.array([3.0, 5, 4, 6, 5, 2, 3, 1]), np.array([0.0, 2, 3, 4, 3, 1, 2, 0.5])
    lattice = lattice_lm.probabilities(pieces, uses, lasts)
    if byte_floor is not None:  # no bytes: all mass is with words over a and b
        share = np.where(pieces.first, 0, np.exp(lattice.go) + np.exp(lattice.end))
        share[-1] = 0
        shift = np.where(pieces.first, 0.0, -np.log(share.sum()))
        lattice.go, lattice.end = lattice.go + shift, lattice.end + shift
        lattice.go[-1] = lattice.end[-1] = byte_floor
    return pieces, lattice


def log_of(lattice, word):
    return float(lattice.batch(next(lattice_lm._same_length([word]))[1])[0])


def spellings(lattice, word):
    """(log probability, pieces) of every segmentation; a character without a piece, or beside one, is its bytes."""
    text, index = lattice_lm.MARK + word, {p: k for k, p in enumerate(lattice.pieces.names)}
    byte = len(index)
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        ways = [(0.0, [])]
        for k, (i, j) in enumerate(zip(edges, edges[1:])):
            logs, options = lattice.end if j == len(text) else lattice.go, []
            if (p := index.get(text[i:j])) is not None and bool(lattice.pieces.first[p]) == (k == 0):
                options.append((logs[p], [p]))
            if j == i + 1 and k:
                n = len(text[i].encode())
                options.append(((n - 1) * lattice.go[byte] + logs[byte], [byte] * n))
            ways = [(w + o, u + v) for w, u in ways for o, v in options]
        yield from ways


def test_lattice_sums_all_segmentations():
    _, lattice = toy()
    for word in ["a", "ab", "aba", "abab", "babab", "b", "\u00e9a", "a\u20acb", "\U0001f600"]:
        assert math.isclose(log_of(lattice, word), math.log(math.fsum(math.exp(w) for w, _ in spellings(lattice, word))), rel_tol=1e-9), word
    assert log_of(lattice, "ab\u2581") > -100  # the mark inside a word is spelled by bytes


def test_expected_uses():
    pieces, lattice = toy()
    words = {"ab": 3, "abab": 2, "babab": 1, "\u00e9a": 4, "b": 5}
    uses, lasts = np.zeros(len(lattice.go)), np.zeros(len(lattice.go))
    for which, points in lattice_lm._same_length(list(words)):
        lattice.expect(points, np.array(list(words.values()), float)[which], uses, lasts)
    want_uses, want_lasts = np.zeros(len(uses)), np.zeros(len(uses))
    for word, c in words.items():
        ways = [(math.exp(w), u) for w, u in spellings(lattice, word) if w > -math.inf]
        total = math.fsum(w for w, _ in ways)
        for w, used in ways:
            for p in used:
                want_uses[p] += c * w / total
            want_lasts[used[-1]] += c * w / total
    assert np.allclose(uses, want_uses) and np.allclose(lasts, want_lasts)
    better = lattice_lm.probabilities(pieces, uses, lasts)
    assert sum(c * log_of(better, w) for w, c in words.items()) > sum(c * log_of(lattice, w) for w, c in words.items())


def test_word_probabilities_sum_to_one():
    _, lattice = toy(-300.0)
    by_size = [sum(math.exp(log_of(lattice, "".join(w))) for w in itertools.product("ab", repeat=n)) for n in range(1, 12)]
    falls = by_size[-1] / by_size[-2]  # longer words: a geometric tail
    assert math.isclose(sum(by_size) + by_size[-1] * falls / (1 - falls), 1.0, rel_tol=1e-3)
    lattice.end -= 0.05
    assert sum(math.exp(log_of(lattice, "".join(w))) for n in range(1, 12) for w in itertools.product("ab", repeat=n)) < 0.97


def test_every_score_of_a_table(spark, sf_dir):
    """The scores of the query against plain sums over each word's lattice, with the learned pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    counts, ends = Counter(), 0
    for doc, text in rows:
        if not brute.held(doc, 5, 1):
            counts.update(brute.WORD.findall(brute.lower(text or "")))
            ends += 1
    words = spark.createDataFrame(list(counts.items()), "word string, c long")
    lattice = lattice_lm.learn(words)
    names = lattice.pieces.names
    first, later = ({p: (lattice.go[k], lattice.end[k]) for k, p in enumerate(names) if p.startswith("\u2581") == kind} for kind in (True, False))
    byte, longest = (lattice.go[-1], lattice.end[-1]), max(map(len, names))

    @functools.cache
    def word_log(word):
        text = "\u2581" + word
        prob = [0.0] * (len(text) + 1)  # scaled by e^scale, so that long words don't vanish
        scale, prob[0] = 0.0, 1.0
        for j in range(1, len(text) + 1):
            end = int(j == len(text))
            for i in range(max(0, j - longest), j):
                if p := (later if i else first).get(text[i:j]):
                    prob[j] += prob[i] * math.exp(p[end])
            if j > 1:
                n = len(text[j - 1].encode())
                prob[j] += prob[j - 1] * math.exp((n - 1) * byte[0] + byte[end])
            if 0 < prob[j] < 1e-100 and j > longest:
                scale -= math.log(1e100)
                prob[max(0, j - longest) : j + 1] = [x * 1e100 for x in prob[max(0, j - longest) : j + 1]]
        return math.log(prob[-1]) + scale

    total = sum(counts.values()) + ends
    p_end = (ends + 0.5) / (total + 1)
    got = {r.doc_id: r.score for r in lattice_lm.op3_lattice_lm(spark, sf_dir).collect()}
    for doc, text in rows:
        own = brute.WORD.findall(brute.lower(text or ""))
        want = (math.fsum(map(word_log, own)) + len(own) * math.log1p(-p_end) + math.log(p_end)) / math.log(10)
        assert math.isclose(got[doc], want, rel_tol=1e-9)


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a-1", "one two"), (None, None), ("b", "two")], "doc_id string, text string")
    got = {r.doc_id: r.n_tokens for r in lattice_lm.likelihood(df, toxicity.held_out("doc_id", 5, 1)).collect()}
    assert got == {"a-1": 3, None: 1, "b": 2}


def test_lattice_learns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lattice_lm.likelihood(docs, toxicity.held_out("doc_id", 5, 1))
    real, broken = docs.filter("lang = 'en'"), docs.filter("lang = 'en'").withColumn("text", F.reverse("text"))
    per_token = lambda df: df.agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    train = real.withColumn("held", F.lit(False)).unionByName(broken.withColumn("held", F.lit(True)))
    both = lattice_lm.likelihood(train, F.col("held"))
    assert got.filter("score >= 0").count() == 0
    assert per_token(both.filter("not held_out")) > per_token(both.filter("held_out")) + 1


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    found = toxicity.op10_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out")
    n, right, toxic, caught = found.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("toxic")), F.sum("toxic"), F.sum(F.col("predicted") * F.col("toxic"))).first()
    assert right / n > 0.93 and caught / toxic > 0.8


def paths(machine, clause):
    """(symbols given off, scales) of every accepting path of a transducer over a list of symbols."""
    found = [(machine.start, [], [])]
    for symbol in clause:
        found = [(to, out + [x], scales + [w]) for state, out, scales in found for to, x, w in machine.arcs.get((state, symbol), ())]
    return [(out, scales) for state, out, scales in found if state in machine.finals]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(toxicity.SYMBOLS), max_size=7))
def test_composition_is_one_machine_after_the_other(clause):
    parts = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.threat()]
    for n in range(2, 5):
        whole = functools.reduce(toxicity.compose, parts[:n])
        cascade = [(clause, [1.0] * len(clause))]
        for part in parts[:n]:
            cascade = [(out, [a * b for a, b in zip(scales, more)]) for read, scales in cascade for out, more in paths(part, read)]
        assert sorted(paths(whole, clause)) == sorted(cascade)


def clause_weight(grammar, words):
    """The weight of a clause straight from the definitions, over the choices of words with two symbols."""
    best = 0.0
    for choice in itertools.product(*(grammar.symbols(w) for w in words)):
        aimed = any(s == "target" for s, _ in choice)
        total, negated, told = 0.0, 0, False
        for symbol, weight in choice:
            scale = (toxicity.NEGATED if negated else 1) * (toxicity.REPORTED if told else 1)
            if symbol == "insult":
                total += weight * scale * (toxicity.BOOST if aimed else 1)
            elif symbol == "harm" and aimed:
                total += weight * scale
            negated = toxicity.SPAN if symbol == "negation" else max(0, negated - 1)
            told = told or symbol == "report"
        best = max(best, total)
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("idiot scum kill die you he not said plain words grim".split()), max_size=8))
def test_clauses_by_definition(words):
    grammar = toxicity.Grammar({"grim$": 1.5, "die$": 0.7}, {"grim": 2.0})
    best, total, share = grammar.features(" ".join(words))
    want = clause_weight(grammar, words)
    assert math.isclose(best, want) and math.isclose(total, math.log1p(want)) and share == float(want > 0)


def test_every_toxicity_score_of_a_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit(docs, labels.filter(~toxicity.held_out("doc_id", 4, 2)))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity.op10_toxicity(spark, sf_dir).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        clauses = [re.findall(r"""[^\W\d_]+|["\u201c\u201e\u00ab]""", c) for c in re.split(r"[.!?;:\n|]", (text or "").lower())]
        weights = [clause_weight(grammar, c) for c in clauses if c]
        hits = [w for w in weights if w]
        x = (max(hits, default=0.0), math.log1p(sum(hits)), len(hits) / len(weights) if hits else 0.0)
        want = 1 / (1 + math.exp(-(grammar.weights[0] + sum(a * b for a, b in zip(grammar.weights[1:], x)))))
        assert math.isclose(got[doc][0], want, rel_tol=1e-9) and got[doc][1:] == (int(want >= 0.3), brute.held(doc, 4, 2))


def test_harm_is_learned_from_clauses_with_a_target(spark):
    rows = [(k, f"Words about w{k % 7}. You will grok soon." if k % 2 else f"Words w{k % 7}. The grok is here. You like it.", k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(df, df)
    assert any("grok".startswith(s.rstrip("$")) for s in grammar.harms) and not any("grok".startswith(s.rstrip("$")) for s in grammar.stems)


def test_grammar_composes():
    g = toxicity.Grammar({}, {}, (-4.0, 1.0, 1.0, 1.0))
    plain = g.features("You are an idiot.")
    assert plain[0] > g.features("The idiot.")[0] > g.features("Not an idiot.")[0] > 0
    assert g.features("She said idiot.")[0] < g.features("She is an idiot.")[0]
    assert g.features("I will kill you.")[0] > 0 == g.features("I will kill time.")[0]
    assert g.features("Nothing here.") == (0.0, 0.0, 0.0) == g.features("")
