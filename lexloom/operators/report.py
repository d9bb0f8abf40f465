"""Listings, pivots, buckets and deletes over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

FLAGGED = ("high", "medium")
REVIEW = ("needs_manual_review", "flagging_failed")


def severity_summary(flags: DataFrame, key: str) -> DataFrame:
    """(key, clauses_flagged, clauses_needs_review, clauses_no_flag) in one pass."""
    s = F.col("severity")
    return flags.groupBy(key).agg(
        F.count_if(s.isin(*FLAGGED)).alias("clauses_flagged"),
        F.count_if(s.isin(*REVIEW)).alias("clauses_needs_review"),
        F.count_if(s == "low").alias("clauses_no_flag"),
    )


def with_summary(contracts: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Left join of the summary; contracts without flags get zeros."""
    names = ("clauses_flagged", "clauses_needs_review", "clauses_no_flag")
    return contracts.join(severity_summary(flags, key), key, "left").fillna(0, subset=list(names))


def page(contracts: DataFrame, order_by: str, key: str, limit: int = fixed.PAGE_SIZE, offset: int = 0) -> DataFrame:
    """A page, newest first, with the key as tie-break."""
    return contracts.orderBy(F.desc(order_by), F.asc(key)).offset(offset).limit(min(limit, fixed.MAX_PAGE_SIZE))


def bucket(severity: Column, low_confidence: Column) -> Column:
    """Detail-view bucket: failures count as flagged here."""
    return (
        F.when(severity == "needs_manual_review", "needs_manual_review")
        .when(severity != "low", "flagged")
        .when(low_confidence, "possible_risk")
        .otherwise("no_flag")
    )


def proportions(rows: DataFrame, bucket_col: str = "bucket") -> DataFrame:
    """(bucket, n, percent): percent rounded half up."""
    counts = rows.groupBy(bucket_col).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.floor(100.0 * F.col("n") / F.col("total") + 0.5).cast("long")
    return counts.crossJoin(F.broadcast(total)).select(bucket_col, "n", share.alias("percent"))


def pills(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(pill, n) for each condition that holds somewhere; conditions may overlap."""
    one = rows.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))
    return one.unpivot([], list(conditions), "pill", "n").filter("n > 0")


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in fixed.SEVERITY_ORDER.items() for x in pair))
    return F.try_element_at(table, severity)


def owned(rows: DataFrame, owners: DataFrame, key: str, owner_col: str, owner) -> DataFrame:
    """Rows of one owner; an absent key and another owner's key both give nothing."""
    return rows.join(owners.filter(F.col(owner_col) == owner).select(key), key, "left_semi")


def cascade_delete(gone: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Child tables without the rows of the deleted keys."""
    return {name: rows.join(gone.select(key), key, "left_anti") for name, rows in children.items()}


def set_null_delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows stay; a reference to a deleted key becomes null."""
    dead = gone.select(F.col(key).alias("__dead")).distinct()
    out = rows.join(dead, rows[key] == F.col("__dead"), "left")
    return out.withColumn(key, F.when(F.col("__dead").isNull(), F.col(key))).drop("__dead")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last writer wins by version; of equal versions, the new rows'."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("r"))
    return last.select(key, "r.*").select(*old.columns)


def current_stage(events: DataFrame, key: str, stage: str, *order: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(stage, F.struct(*order)).alias("current_stage"))


def terminal_stage(current: Column, status: Column) -> Column:
    """A failure keeps the last stage and writes ``failed`` only where there is none."""
    return F.when(status == "failed", F.coalesce(current, F.lit("failed"))).when(status == "complete", "complete").otherwise(current)


def backfill_stage(current: Column, status: Column) -> Column:
    return F.when(current.isNull() & status.isin("complete", "failed"), status).otherwise(current)


def progress_index(stage: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in fixed.STAGES)), stage) - 1


def poll_state(polls: DataFrame, key: str, order: str, found: str = "found", stage: str = "stage", tolerance: int = fixed.NOT_FOUND_TOLERANCE) -> DataFrame:
    """(key, order, state) of each poll: the stage, or ``waiting`` while not more than ``tolerance`` polls in a row found nothing, then ``not_found``."""
    w = Window.partitionBy(key).orderBy(order)
    df = polls.withColumn("run", F.sum(F.col(found).cast("int")).over(w))
    misses = F.sum(F.when(F.col(found), 0).otherwise(1)).over(Window.partitionBy(key, "run").orderBy(order))
    state = F.when(F.col(found), F.col(stage)).when(misses <= tolerance, "waiting").otherwise("not_found")
    return df.select(key, order, state.alias("state"))
