"""Suffix order against sorting, and repeats of bytes against every string of every text."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import repeats, suffixes


@pytest.mark.parametrize("letters", [1, 2, 6])
def test_suffix_order(spark, letters):
    random.seed(letters)
    rows, suffix = [], {}
    for doc in range(5):
        at = 0
        for _ in range(3):
            s = [random.randrange(letters) for _ in range(random.randint(0, 40))]
            for j, c in enumerate(s):
                rows.append((doc, at + j, c))
                suffix[doc, at + j] = s[j:]
            at += len(s) + random.randint(1, 3)
    df = spark.createDataFrame(rows, "doc long, idx long, sym long").repartition(4)
    found = {(r.doc, r.idx): r.rank for r in suffixes.ranks(df, 9).collect()}
    order = [suffix[k][:9] for k in sorted(found, key=found.get)]
    assert set(found) == set(suffix) and order == sorted(order)


def test_numbers_across_tasks(spark):
    rows = [(k // 50, k, k % 3 == 0) for k in range(300)] + [(7, 400, False)]
    df = spark.createDataFrame(rows, "key long, k long, flag boolean").repartition(5)
    got = sorted(tuple(r) for r in suffixes.numbered(df, ["key", "k"], ["key"], "flag").collect())
    assert got == [(key, k, flag, at, at // 50 * 50, at < 300, sum(r[2] for r in rows[:at])) for at, (key, k, flag) in enumerate(rows)]


def by_every_string(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            counts[t[k : k + length]] = counts.get(t[k : k + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.diff(np.concatenate([[0], gone[: len(t)].astype(int), [0]]))
        out.append((i, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def planted(seed, letters, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (length - 1, length, length + 1, 2 * length, 5 * length)]
    rows = [(k, text(rng.randint(0, length)) + rng.choice(shared) + text(rng.randint(0, length)) + rng.choice(shared) + text(rng.randint(0, 3))) for k in range(60)]
    rows += [(100, "ab" * 3 * length), (101, "b" * 2 * length), (102, "é𝄞" * length), (103, None), (104, ""), (None, "short"), (None, None)]
    rows += [rows[3], rows[4], (200, rows[4][1]), (201, rows[5][1] + "!"), (202, "?" + rows[5][1])]
    near = list(shared[4] * 2)
    for k in range(12):
        near[rng.randrange(len(near))] = "#"
        rows.append((300 + k, "".join(near)))
    return rows


@pytest.mark.parametrize("seed, letters, length", [(1, "abcdefghijklmnop qrst", 40), (2, "ab", 24), (3, "abc ", 8), (4, "abcdefgh ", 400)])
def test_same_as_every_string(spark, seed, letters, length):
    rows = planted(seed, letters, length)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, sha int").repartition(4)
    found = repeats.remove_repeats(df, length=length)
    assert as_rows(found) == by_every_string(rows, length)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = repeats.remove_repeats(df)
    assert as_rows(found) == by_every_string(rows, 400)
    assert found.select(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.stop - s.start)) == F.sum("n_removed")).first()[0]


def test_empty_table_and_other_ids(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([("a", "x" * 500), (None, "y" * 399)], "doc_id string, text string")
    assert as_rows(repeats.remove_repeats(df)) == by_every_string([("a", "x" * 500), (None, "y" * 399)], 400)


def test_prefixes_meet_in_the_suffix_order(spark):
    """Texts that leave a shared string early lie between those that share it whole."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for _ in range(250):
        shared = text(100)
        rows += [(len(rows) + k, text(30) + shared + text(40)) for k in range(2)]
        rows += [(len(rows) + k, shared[: rng.randint(50, 98)] + text(60)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_rows(repeats.remove_repeats(df, length=100)) == by_every_string(rows, 100)


def test_few_single_strings_are_compared(spark, monkeypatch):
    """Near copies give off strings at the edges of what they share, not all strings of an anchor."""
    rng, compared = random.Random(5), []
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for _ in range(30):
        passage = list(text(3000))
        for at in (0, 700, 1500, 2300):
            changed = passage.copy()
            changed[at] = "#"
            rows.append((len(rows), "".join(changed)))
    shared = repeats.shared_tokens
    monkeypatch.setattr(repeats, "shared_tokens", lambda found, by: compared.append(found.count() if by == "start" else 0) or shared(found, by))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_rows(repeats.remove_repeats(df)) == by_every_string(rows, 400)
    assert 0 < sum(compared) < len(rows) * 150
