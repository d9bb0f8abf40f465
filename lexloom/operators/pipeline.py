"""Documents to assessed clauses in one plan per table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text
from . import assess, classify, providers, segment


@dataclass
class Result:
    """The tables that a run produces."""

    clauses: DataFrame
    vectors: DataFrame
    flags: DataFrame
    summary: DataFrame


def run_pipeline(pages: DataFrame, centroids: DataFrame, embed: providers.Embedder = providers.hashed_embedding, assessor=providers.assess) -> Result:
    """Chunk, classify, embed and flag the pages (doc_id, page_number, text).

    Chunks are stored: every table reads them, and documents are cut once. They are deleted by the caller's ``storage.sweep``.
    """
    chunks = segment.chunk_documents(pages)
    chunks = chunks.withColumn("clause_id", text.stable_id(F.col("doc_id").cast("string"), F.col("chunk_ord").cast("string")))
    chunks = storage.stored(chunks, "clauses")
    clauses = classify.cascade(chunks, embed, centroids)
    vectors = embed(chunks.select("doc_id", "clause_id", "text"))
    attempts = assessor(chunks.select("clause_id", "doc_id", "text")).withColumn("n", F.lit(1))
    flags = assess.reduce_validation(attempts, "clause_id").join(chunks.select("clause_id", "doc_id"), "clause_id")
    return Result(clauses, vectors, flags, assess.run_summary(flags, "doc_id", vectors))
