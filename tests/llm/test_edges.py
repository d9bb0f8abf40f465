"""Columns whose names clash with those that operators make, and rows of nulls, for every operator."""

import pytest

from lexloom.llm import chat, decontaminate, lattice_lm, line_dedup, mixing, quality, secrets, shards, simhash, toxicity

ROWS = [(1, "A plain text of more than ten words that ends here, at last.", "s", 1.0), (None, None, None, None), (2, None, "s", None), (1, "A plain text of more than ten words that ends here, at last.", "s", 1.0)]
NAMES = ["row", "fp", "words", "size", "key", "id", "label", "half", "n", "kept", "suspects", "order_key", "s", "a", "b", "component_id", "first", "target", "held", "block", "range", "tokens", "sieve", "copies", "names", "token", "found", "sid", "__id", "__n", "__k", "of", "judged"]


@pytest.fixture(scope="module")
def clash(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars double")
    return df.select("*", *(F.lit("x").alias(n) for n in NAMES))


@pytest.mark.parametrize("run", [
    lambda df, items, labels: quality.clean(df),
    lambda df, items, labels: line_dedup.dedup_lines(df),
    lambda df, items, labels: decontaminate.remove(df, items),
    lambda df, items, labels: decontaminate.report(df, items),
    lambda df, items, labels: mixing.mix(df),
    lambda df, items, labels: simhash.near_duplicates(df),
    lambda df, items, labels: simhash.keep_one(df),
    lambda df, items, labels: secrets.scan(df),
    lambda df, items, labels: shards.materialise_order(df),
    lambda df, items, labels: toxicity.score(df, toxicity.fit(df, labels)),
    lambda df, items, labels: lattice_lm.likelihood(df, toxicity.held_out("doc_id", 5, 1)),
])
def test_clashing_names(run, clash, spark):
    items = spark.createDataFrame([(1, "plain text", "x"), (None, None, "y")], "item_id long, text string, words string")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (None, None, "z")], "doc_id long, toxic int, half string")
    out = run(clash, items, labels)
    assert out.count() >= 1
    if "row" in out.columns:
        assert out.columns == clash.columns


def test_chat_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "u", "hi", "x", "y", "z")], "conv_id long, turn long, role string, text string, conv string, block string, perspective string")
    assert chat.rotate(df).count() == 1
