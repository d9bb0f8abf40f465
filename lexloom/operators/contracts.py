"""The application's entry points over its tables, and their mutations.

Each takes DataFrames and returns DataFrames; "not there" and "not yours" are the same empty result.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources import files
from . import report, retrieve

log = logging.getLogger(__name__)


def ingest(uploads: DataFrame, parsers=None) -> tuple[DataFrame, DataFrame]:
    """(pages, refused): accepted files as pages, others with the reason."""
    checked = files.validate_upload(uploads)
    return files.extract_pages(checked.filter("verdict = 'ok'"), parsers), checked.filter("verdict <> 'ok'").select("path", "length", "verdict")


def list_contracts(contracts: DataFrame, flags: DataFrame, user: str, limit: int = fixed.PAGE_SIZE, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page with severity summary, total): only the page's contracts meet the flags."""
    own = contracts.filter(F.col("user_id") == user)
    shown = report.page(own, "created_at", "id", limit, offset)
    scoped = flags.withColumnRenamed("contract_id", "id").join(shown.select("id"), "id", "left_semi")
    return report.with_summary(shown, scoped.select("id", "severity"), "id"), own.agg(F.count("*").alias("total"))


def contract_status(contracts: DataFrame, clauses: DataFrame, flags: DataFrame, contract_id: str, user: str) -> DataFrame:
    """status, stage, its index, and the counts of clauses and flags."""
    own = contracts.filter((F.col("id") == contract_id) & (F.col("user_id") == user))
    count = lambda df, name: df.filter(F.col("contract_id") == contract_id).agg(F.count("*").alias(name))
    both = own.crossJoin(F.broadcast(count(clauses, "n_clauses"))).crossJoin(F.broadcast(count(flags, "n_flags")))
    return both.select("id", "status", "current_stage", report.progress_index(F.col("current_stage")).alias("progress"), "n_clauses", "n_flags")


def flagged_clauses(contracts: DataFrame, clauses: DataFrame, flags: DataFrame, contract_id: str, user: str) -> DataFrame:
    """Flags with their clauses, by page, order in the document and id; worst severity can be sorted by ``severity_rank``."""
    own = contracts.filter((F.col("id") == contract_id) & (F.col("user_id") == user)).select(F.col("id").alias("contract_id"))
    f = flags.join(own, "contract_id", "left_semi").select("clause_id", "severity", "explanation", "citation")
    c = clauses.filter(F.col("contract_id") == contract_id).select(F.col("id").alias("clause_id"), "heading_path", "text", "page_number", "chunk_ord", "category")
    return f.join(c, "clause_id").withColumn("severity_rank", report.severity_rank(F.col("severity"))).orderBy("page_number", "chunk_ord", "clause_id")


def delete_contracts(gone: DataFrame, clauses: DataFrame, flags: DataFrame, audit: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """The tables after a delete by contract_id; upload events are a log and stay."""
    key = "contract_id"
    return report.cascade_delete(gone, key, {"vectors": vectors, "flags": flags, "audit": audit, "clauses": clauses})


def delete_clauses(gone: DataFrame, clauses: DataFrame, flags: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    """The tables after a delete by clause_id: flags go, the audit trail stays with an empty reference."""
    after = report.cascade_delete(gone, "clause_id", {"flags": flags})
    return after | {"clauses": clauses.join(gone.select(F.col("clause_id").alias("id")), "id", "left_anti"), "audit": report.set_null_delete(audit, gone, "clause_id")}


def delete_counted(rows: DataFrame, gone: DataFrame, key: str) -> tuple[int, DataFrame]:
    """(how many rows there were, the rest)."""
    return rows.join(gone.select(key), key, "left_semi").count(), rows.join(gone.select(key), key, "left_anti")


def append_audit(events: DataFrame, path: str) -> bool:
    """Append to the audit log. A failing write is logged and reported, never raised."""
    try:
        events.write.mode("append").parquet(path)
        return True
    except Exception:
        log.exception("audit events were not written to %s", path)
        return False


def read_evolved(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A table whose older files lack newer columns; missing ones are added as nulls of the given type."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in df.columns))


def ensure_table(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    """Create a Parquet table, or add the columns that an existing one lacks."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({', '.join(f'`{c}` {kind}' for c, kind in columns.items())}) USING parquet")
        return
    have = set(spark.table(name).columns)
    if more := [f"`{c}` {kind}" for c, kind in columns.items() if c not in have]:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(more)})")


def store_index(vectors: DataFrame, path: str) -> None:
    """Write (scope, item_id, embedding, ...) partitioned by scope; the scopes written replace their older rows, others stay."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(path)


def load_index(spark: SparkSession, path: str, *scopes: str) -> DataFrame:
    """The stored vectors, of the given scopes only if there are any: the filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("scope").isin(*scopes)) if scopes else df


def grounding(clauses: DataFrame, items: DataFrame, severities: DataFrame) -> DataFrame:
    """Related clauses for every high or medium clause of a contract, by the full search without the gate's split.

    ``items``: scope (contract), item_id, text, embedding, category; only live clauses are in it.
    """
    asked = severities.filter(F.col("severity").isin(*report.FLAGGED)).select("item_id")
    return retrieve.search_within(items, items.select("scope", "item_id").join(asked, "item_id", "left_semi")).drop("threshold", "is_confident")


def prompt(clause: Column, related: Column) -> Column:
    """The assessor's context: the clause and its related clauses, a blank line between them."""
    return F.concat(F.lit("Clause:\n"), clause, F.when(F.size(related) > 0, F.concat(F.lit("\n\nRelated clauses:\n"), F.array_join(related, "\n\n"))).otherwise(F.lit("")))


def first_match(rows: DataFrame, spans: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """Each row with the first span of its key whose evened-out text is the same."""
    norm = lambda df: df.withColumn("__norm", F.sha2(text.squeeze(F.col(body)), 256))
    extra = [c for c in spans.columns if c not in (key, body)]
    firsts = norm(spans).groupBy(key, "__norm").agg(F.min_by(F.struct(*extra), order).alias("span"))
    return norm(rows).join(firsts, [key, "__norm"]).drop("__norm")
