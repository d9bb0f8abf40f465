"""Reductions of attempt logs to audited outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .report import FLAGGED


def flag_error(raw: Column) -> Column:
    """Why a tool output is refused; null for a valid one. Types are not coerced."""
    v = F.try_parse_json(raw)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    out = F.when(v.isNull(), "not json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    for name in ("severity", "explanation", "citation"):
        out = out.when(kind(name).isNull() | (kind(name) == "VOID"), f"{name}: missing").when(kind(name) != "STRING", f"{name}: not a string")
    return out.when(~F.try_variant_get(v, "$.severity", "string").isin(*fixed.SEVERITIES), "severity: not allowed")


def flag_of(raw: Column) -> Column:
    """struct(severity, explanation, citation) of a valid output."""
    v = F.try_parse_json(raw)
    return F.struct(*(F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in ("severity", "explanation", "citation")))


def retry_reason(code: Column, retry_after: Column) -> Column:
    """rate_limited, exhausted (a long wait is asked for), unavailable, or null for no retry."""
    wait = retry_after.try_cast("double")
    return F.when(code == 429, F.when(wait >= fixed.LONG_RETRY_S, "exhausted").otherwise("rate_limited")).when(code == 503, "unavailable")


def reduce_calls(attempts: DataFrame, key: str, max_retries: int = 2) -> DataFrame:
    """(key, outcome, n_calls) from (key, n, code, retry_after), n from 1.

    ok: the first success, if all calls before it could be retried and there were at most ``max_retries``.
    exhausted: a long wait is asked for, which no retry in this run can outlast (it trips the breaker). failed: any other
    error, and retries that are used up: that costs the clause and no more.
    """
    reason = retry_reason(F.col("code"), F.col("retry_after"))
    a = attempts.withColumn("reason", F.when(F.col("code") == 200, "ok").otherwise(F.coalesce(reason, F.lit("failed")))).filter(F.col("n") <= max_retries + 1)
    stop = F.col("reason").isin("ok", "exhausted", "failed") | (F.col("n") == max_retries + 1)
    ends = a.filter(stop).groupBy(key).agg(F.min_by(F.struct("reason", "n"), "n").alias("e"))
    outcome = F.when(F.col("e.reason").isin("rate_limited", "unavailable"), "failed").otherwise(F.col("e.reason"))
    return ends.select(key, outcome.alias("outcome"), F.col("e.n").cast("long").alias("n_calls"))


def reduce_validation(attempts: DataFrame, key: str, retries: int = 1) -> DataFrame:
    """(key, severity, explanation, citation) of the first valid output of the first ``retries`` + 1, else needs_manual_review."""
    a = attempts.filter(F.col("n") <= retries + 1).withColumn("error", flag_error(F.col("raw")))
    best = a.groupBy(key).agg(F.min_by(F.when(F.col("error").isNull(), flag_of(F.col("raw"))), F.when(F.col("error").isNull(), F.col("n"))).alias("f"), F.min_by("error", "n").alias("first_error"))
    return best.select(key, F.coalesce("f.severity", F.lit("needs_manual_review")).alias("severity"), F.col("f.explanation").alias("explanation"), F.col("f.citation").alias("citation"), "first_error")


def circuit_breaker(outcomes: DataFrame, run: str, *order: str, tripped: Column) -> DataFrame:
    """Adds ``skipped``: an earlier outcome of the same run tripped the breaker."""
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return outcomes.withColumn("skipped", F.coalesce(F.max(tripped).over(before), F.lit(False)))


def outcome_row(outcome: Column, skipped: Column, flag: Column, clause_text: Column) -> Column:
    """struct(severity, explanation, citation) to store; the clause text is the fallback citation."""
    failed = F.struct(F.lit("flagging_failed").alias("severity"), F.lit(None).cast("string").alias("explanation"), clause_text.alias("citation"))
    review = F.struct(F.lit("needs_manual_review").alias("severity"), F.lit(None).cast("string").alias("explanation"), clause_text.alias("citation"))
    ok = F.struct(flag["severity"].alias("severity"), flag["explanation"].alias("explanation"), F.coalesce(flag["citation"], clause_text).alias("citation"))
    return F.when(skipped | (outcome == "exhausted") | (outcome == "failed"), failed).when(outcome == "review", review).otherwise(ok)


def audit_events(clauses: DataFrame, calls: DataFrame, outputs: DataFrame, suggestions: DataFrame, key: str, max_retries: int = 2, retries: int = 1) -> DataFrame:
    """(key, seq, event_type): the audit trail of assessed clauses, numbered from 0 in the order of events.

    ``clauses``: key, skipped (an open breaker: nothing was called). ``calls``: key, n, code, retry_after. ``outputs``: key, n,
    raw. ``suggestions``: key, n, cited, retrieved, failed. The types are those of ``fixed.AUDIT_EVENTS``: each call that is
    tried again, the one that ends in failure, each refused output, the output that a second try made valid, the end of
    tries, the decision, and for suggestions those that cite what was not retrieved in all tries, and those that failed. Only
    clauses whose accepted output is high or medium are asked for suggestions; rows of ``suggestions`` for others are passed over.
    """
    live = clauses.filter(~F.col("skipped")).select(key)
    done = reduce_calls(calls, key, max_retries).select(key, "outcome", "n_calls")
    call = calls.join(live, key, "left_semi").join(done, key).filter(F.col("n") <= F.col("n_calls"))
    failed = F.col("outcome") != "ok"
    kind = F.when(F.col("n") < F.col("n_calls"), "api_error_retry").when(failed, "api_error_failed")
    events = [call.select(key, F.lit(0).alias("phase"), F.col("n").cast("long").alias("at"), kind.alias("event_type"))]
    answered = live.join(done.filter("outcome = 'ok'"), key, "left_semi")
    out = outputs.join(answered, key, "left_semi").filter(F.col("n") <= retries + 1).withColumn("error", flag_error(F.col("raw")))
    first = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("over", F.coalesce(F.max(F.col("error").isNull()).over(first), F.lit(False))).filter(~F.col("over"))
    last = F.when(F.col("n") == retries + 1, F.lit("validation_needs_manual_review"))
    kinds = F.when(F.col("error").isNull(), F.array(F.when(F.col("n") > 1, F.lit("validation_retry_success")))).otherwise(F.array(F.lit("validation_failure"), last))
    refused = out.select(key, F.lit(1).alias("phase"), F.col("n").cast("long").alias("n"), F.posexplode(kinds).alias("k", "event_type"))
    events.append(refused.select(key, "phase", (F.col("n") * 2 + F.col("k")).alias("at"), "event_type"))
    events.append(clauses.select(key, F.lit(2).alias("phase"), F.lit(0).cast("long").alias("at"), F.lit("final_flag_decision").alias("event_type")))
    flagged = out.filter(F.col("error").isNull() & flag_of(F.col("raw"))["severity"].isin(*FLAGGED)).select(key)
    judged = reduce_suggestions(suggestions.join(flagged, key, "left_semi"), key, retries)
    kind = F.when(F.col("status") == "failed", "grounding_error").when(F.col("status") == "needs_manual_review", "grounding_failure")
    events.append(judged.select(key, F.lit(3).alias("phase"), F.lit(0).cast("long").alias("at"), kind.alias("event_type")))
    every = events[0]
    for more in events[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy(key).orderBy("phase", "at")
    return every.filter("event_type is not null").select(key, (F.row_number().over(order) - 1).cast("long").alias("seq"), "event_type")


def reduce_suggestions(suggestions: DataFrame, key: str, retries: int = 1) -> DataFrame:
    """(key, status, n): the first of ``retries`` + 1 suggestions that cites only what was retrieved.

    ``suggestions``: key, n, cited, retrieved (of this clause's own call), failed. grounded; needs_manual_review after tries that all
    cite something else; failed if a call before that fails.
    """
    a = suggestions.filter(F.col("n") <= retries + 1)
    kind = F.when(F.col("failed"), "failed").when(F.size(ungrounded(F.col("cited"), F.col("retrieved"))) == 0, "grounded")
    a = a.withColumn("kind", kind)
    ends = a.groupBy(key).agg(F.min_by(F.when(F.col("kind").isNotNull(), F.struct("kind", "n")), F.when(F.col("kind").isNotNull(), F.col("n"))).alias("e"), F.max("n").alias("tries"))
    return ends.select(key, F.coalesce("e.kind", F.lit("needs_manual_review")).alias("status"), F.coalesce("e.n", "tries").cast("long").alias("n"))


def ungrounded(cited: Column, retrieved: Column) -> Column:
    """Cited ids that were not retrieved, in order and with repeats."""
    return F.filter(cited, lambda x: ~F.array_contains(retrieved, x))


def run_summary(rows: DataFrame, run: str, vectors: DataFrame | None = None) -> DataFrame:
    """(run, persisted, indexed, flagged, failed): indexed is the number of the run's rows of ``vectors``, or all."""
    s = F.col("severity")
    out = rows.groupBy(run).agg(F.count("*").alias("persisted"), F.count_if(s.isin(*fixed.SEVERITIES)).alias("flagged"), F.count_if(s.isin("flagging_failed", "needs_manual_review")).alias("failed"))
    if vectors is None:
        return out.select(run, "persisted", F.col("persisted").alias("indexed"), "flagged", "failed")
    indexed = vectors.groupBy(run).agg(F.count("*").alias("indexed"))
    return out.join(indexed, run, "left").select(run, "persisted", F.coalesce("indexed", F.lit(0)).alias("indexed"), "flagged", "failed")
