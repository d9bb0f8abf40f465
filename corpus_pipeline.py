"""The corpus pipeline: five stages, each a table of documents in and out (the last one gives token shards).

Part of ``lexloom.llm``; a stage is written as Parquet and read again before the next begins, and what the stage before
and its own steps had stored is deleted then.

Cases: an empty table gives empty tables and no shards; documents without text fail the quality rules; where a stage
leaves no rows, all later ones are empty; extra columns pass through to the mixed documents; rows without an id
are never taken for copies; a document that repeats an id is kept or dropped by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, mixing, quality, shards, simhash
from lexloom.llm.store import mark, materialise, sweep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: its smallest id.

    The production setting for near duplicates: five words to a shingle, similarity 0.8.
    """
    return simhash.keep_one(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept or left out so that the sources meet their targets."""
    return mixing.mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all mixed documents in training order."""
    return shards.materialise_order(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("mix", mix_sources),
    ("token_shards", token_shards),
]

#: Feistel order, fingerprints and the automaton are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    begin = mark()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, begin, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
