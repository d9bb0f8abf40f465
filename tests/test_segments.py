"""Heading stacks of any depth, byte-pair counts, and segmentation with them."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.operators import segment, tokens

LINES = "doc_id long, line_no int, line string, level int"


def closed_by(lines):
    """Each line's path by the definition: the ancestor at level k is the last heading of level k or less, if its level is k."""
    out = {}
    for d, n, _, _ in lines:
        heads = [(lv, t) for e, m, t, lv in lines if e == d and m <= n and lv is not None]
        path = []
        for k in range(1, 1 + max((lv for lv, _ in heads), default=0)):
            last = [h for h in heads if h[0] <= k][-1:]
            path += [t for lv, t in last if lv == k]
        out[d, n] = " > ".join(path) or fixed.UNTITLED
    return out


def test_heading_stack(spark):
    rng = random.Random(2)
    lines = [(d, n, f"t{d}-{n}", rng.choice([None, None, 1, 2, 3, 7, 120])) for d in range(6) for n in range(40)]
    df = spark.createDataFrame(lines, LINES)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents go over several batches
    try:
        got = {(r.doc_id, r.line_no): r.heading_path for r in segment.breadcrumbs(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == closed_by(lines)


def test_heading_plan_has_one_width(spark):
    def nodes(depth):
        df = spark.createDataFrame([(1, k, f"h{k}", k) for k in range(1, depth + 1)], LINES)
        return segment.breadcrumbs(df)._jdf.queryExecution().analyzed().treeString().count("\n")

    assert nodes(3) == nodes(120)
    deep = spark.createDataFrame([(1, 1, "Section " + ".".join(["1"] * 120), 120), (1, 2, "text", None)], LINES)
    assert [r.heading_path for r in segment.breadcrumbs(deep).orderBy("line_no").collect()] == ["Section " + ".".join(["1"] * 120)] * 2
    assert segment.breadcrumbs(deep.limit(0)).collect() == []


@pytest.fixture(scope="module")
def encoder():
    if not os.path.exists(tokens.RANKS):
        pytest.skip("no vocabulary file")
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokens.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={}), ranks


ODD = ["", None, " ", "\n\n  x", "a b  c", "don't WE'LL it's", "日本語のテキスト 漢字", "émigré naïve ﬁ", "😀👍🏽 ok", "x" * 5000, "ab" * 3000, "1234567 ½ ²", "﻿\x00\x1c\x85 end  ", "!!!???...---" * 50, "same", "same"]


def test_token_counts_are_the_encoders(spark, sf_dir, encoder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    rows = tokens.counted(docs.unionByName(odd), ["doc_id"]).collect()
    assert len(rows) == docs.count() + len(ODD)
    assert [(r.doc_id, r.n_tokens) for r in rows if r.n_tokens != len(encoder[0].encode_ordinary(r.text or ""))] == []


def test_merges_against_the_plain_rule(encoder):
    _, ranks = encoder
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("abetionsrzq é") for _ in range(rng.randrange(1, 30))).encode()
        parts = [word[i : i + 1] for i in range(len(word))]
        while pairs := [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert tokens.merged_length(word, ranks) == len(parts)


def test_chunks_with_the_encoders_counts(spark, encoder):
    long = " ".join(f"Sentence number {k} speaks of indemnification and untranslatables." for k in range(120))
    pages = [(1, 1, "1. First\nShort text here."), (1, 2, "2. Second\n" + long), (2, 1, "no heading at all"), (3, 1, long), (3, 2, long)]
    df = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    rows = segment.chunk_documents(df, counter=tokens.counted).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    assert max(r.n_tokens for r in rows) <= fixed.MAX_TOKENS
    assert [r.page_number for r in sorted((r for r in rows if r.doc_id == 3), key=lambda r: r.chunk_ord)] == sorted(r.page_number for r in rows if r.doc_id == 3)
    for doc in (1, 2, 3):
        said = " ".join(r.text for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.chunk_ord)).split()
        assert said == " ".join(t for d, _, t in pages if d == doc).split()
    single = [r for r in rows if r.doc_id == 2]
    assert [r.n_tokens for r in single] == [len(encoder[0].encode_ordinary("no heading at all"))]
