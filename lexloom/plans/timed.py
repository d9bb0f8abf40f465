"""Quotas, pacing, breakers and their streaming twins over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators import assess, observe, quota, report
from ..streaming import machines, twins
from .base import SQL, Derived, query, table


@query(
    """SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 10 AS accepted, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE) AS reset_at FROM events"""
)
def daily_quota(spark, d):
    return quota.daily_quota(table(spark, d, "events")).select("event_id", "user_id", "day", "accepted", "reset_at")




@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch_us(ts) / 1000000)::BIGINT AS pos, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000000)::BIGINT, event_id) AS k FROM events),
    p AS (SELECT user_id, event_id, k, pos AS start_s FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(e.pos, p.start_s + 3) FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
    SELECT event_id, start_s FROM p"""
)
def pace_fixed_floor(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("at"))
    return quota.fixed_floor_pace(e, "user_id", "event_id", "at").select("event_id", "start_s")


#: Requests that come close enough to one another for every rule: seconds from the event's id.
_SENDS = Derived("SELECT user_id, event_id, CAST((event_id * 37) % 4000 + event_id % 7 AS DOUBLE) AS sec FROM events")


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS k FROM {_SENDS.sql}),
    p AS (SELECT user_id, event_id, k, true AS sent, CAST(NULL AS BIGINT) AS retry_after_s, sec AS first, sec AS last, 1 AS n FROM e WHERE k = 1
      UNION ALL SELECT user_id, event_id, k, NOT cool AND NOT full_, CAST(CASE WHEN cool THEN floor(60 - (sec - last)) + 1 WHEN full_ THEN floor(900 - (sec - first)) + 1 END AS BIGINT),
        CASE WHEN NOT cool AND NOT full_ AND fresh THEN sec ELSE first END, CASE WHEN NOT cool AND NOT full_ THEN sec ELSE last END, CASE WHEN cool OR full_ THEN n WHEN fresh THEN 1 ELSE n + 1 END
      FROM (SELECT e.user_id, e.event_id, e.k, e.sec, p.first, p.last, p.n, e.sec - p.last < 60 AS cool, e.sec - p.first >= 900 AS fresh, e.sec - p.first < 900 AND p.n >= 5 AS full_ FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1))
    SELECT user_id, event_id, sent, retry_after_s FROM p"""
)
def otp_window(spark, d):
    return quota.otp_sends(_SENDS.df(spark, d), "user_id", "event_id", "sec").select("user_id", "event_id", "sent", "retry_after_s")


_TRIES = Derived("SELECT user_id * 1000 + event_id % 40 AS code_id, event_id, CAST(event_id % 640 AS DOUBLE) AS sec, CAST(0 AS DOUBLE) AS issued, event_id % 9 = 0 AS ok FROM events")


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY code_id ORDER BY sec, event_id) AS k FROM {_TRIES.sql}),
    p AS (SELECT code_id, event_id, k, CASE WHEN sec - issued >= 600 THEN 'expired' WHEN ok THEN 'verified' ELSE 'wrong' END AS verdict, 1 AS wrong FROM e WHERE k = 1
      UNION ALL SELECT e.code_id, e.event_id, e.k, CASE WHEN p.verdict <> 'wrong' THEN 'cleared' WHEN e.sec - e.issued >= 600 THEN 'expired' WHEN e.ok THEN 'verified' WHEN p.wrong + 1 >= 5 THEN 'locked' ELSE 'wrong' END, p.wrong + 1 FROM p JOIN e ON e.code_id = p.code_id AND e.k = p.k + 1)
    SELECT code_id, event_id, verdict FROM p"""
)
def otp_verify(spark, d):
    return quota.otp_verify(_TRIES.df(spark, d), "code_id", "event_id", "sec", "ok", "issued").select("code_id", "event_id", "verdict")


_CALLS = Derived("SELECT user_id AS provider, event_id, CAST((event_id * 13) % 3000 AS DOUBLE) AS sec, CAST(500 + (event_id * 97) % 6000 AS INTEGER) AS tokens FROM events")


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY sec, event_id) AS k FROM {_CALLS.sql}),
    p AS (SELECT provider, event_id, k, sec AS start_s, [{{'t': sec, 'n': tokens}}] AS held FROM e WHERE k = 1
      UNION ALL SELECT provider, event_id, k, start_s, list_append(held, {{'t': start_s, 'n': tokens}}) FROM (
        SELECT *, now + greatest(21 - (now - last), CASE WHEN len(held) > 0 AND coalesce(list_sum(list_transform(held, lambda h: h.n)), 0) + tokens > 10000 THEN 60 - (now - held[1].t) ELSE 0 END, 0) AS start_s FROM (
          SELECT *, list_filter(before, lambda h: now - h.t < 60) AS held FROM (SELECT e.provider, e.event_id, e.k, e.tokens, p.start_s AS last, greatest(e.sec, p.start_s) AS now, p.held AS before FROM p JOIN e ON e.provider = p.provider AND e.k = p.k + 1))))
    SELECT provider, event_id, start_s FROM p"""
)
def token_pace(spark, d):
    return quota.token_pace(_CALLS.df(spark, d), "provider", "event_id", "sec", "tokens").select("provider", "event_id", "start_s")


@query(r"SELECT lang, count(*) AS n_calls, sum(n_chars)::BIGINT AS tokens, (count(*) - 1) * 21 AS seconds, sum(n_chars) > 10000 AS over_budget FROM documents GROUP BY lang")
def embedding_estimate(spark, d):
    return quota.embedding_estimate(table(spark, d, "documents").select("lang", "n_chars"), "lang", "n_chars")


@query("SELECT doc_id, spent FROM (SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM documents) WHERE spent < 20000")
def budget_stop(spark, d):
    return quota.budget_stop(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id", "n_chars", 20_000, "source").select("doc_id", "spent")


@query("SELECT doc_id, spent FROM (SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent, sum(n_chars) OVER () AS total FROM documents) WHERE spent < total // 2")
def budget_stop_global(spark, d):
    """One budget over the whole batch: half of its tokens."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    half = docs.agg(F.sum("n_chars")).first()[0] or 0
    return quota.budget_stop(docs, "doc_id", "n_chars", half // 2).select("doc_id", "spent")


@query(
    """SELECT event_id, user_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM events"""
)
def circuit_breaker(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return assess.circuit_breaker(e, "user_id", "ts", "event_id", tripped=F.col("event_type") == "error").select("event_id", "user_id", "skipped")


_OUTCOMES = Derived(
    "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'exhausted' WHEN 2 THEN 'failed' ELSE 'ok' END AS outcome, event_id % 7 = 0 AS skipped, CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity, CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END AS citation, props AS text FROM events"
)


@query(
    f"""SELECT id, CASE WHEN skipped OR outcome IN ('exhausted', 'failed') THEN 'flagging_failed' WHEN outcome = 'review' THEN 'needs_manual_review' ELSE severity END AS severity,
    CASE WHEN skipped OR outcome IN ('exhausted', 'failed') OR outcome = 'review' THEN text ELSE coalesce(citation, text) END AS citation FROM {_OUTCOMES.sql}"""
)
def outcome_rows(spark, d):
    flag = F.struct("severity", F.lit("e").alias("explanation"), "citation")
    return _OUTCOMES.df(spark, d).select("id", assess.outcome_row(F.col("outcome"), F.col("skipped"), flag, F.col("text")).alias("r")).select("id", "r.severity", "r.citation")


_POLLS = Derived("SELECT user_id, event_id, event_type <> 'error' AND event_id % 3 = 0 AS found, event_type AS stage FROM events")


@query(
    f"""WITH r AS (SELECT *, sum(CAST(found AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM {_POLLS.sql}),
    m AS (SELECT *, sum(CASE WHEN found THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS misses FROM r)
    SELECT user_id, event_id, CASE WHEN found THEN stage WHEN misses <= 3 THEN 'waiting' ELSE 'not_found' END AS state FROM m"""
)
def poll_state(spark, d):
    return report.poll_state(_POLLS.df(spark, d), "user_id", "event_id")


def _drained(spark, sf_dir, build, *keys):
    """Run a stream over ``events`` to its end and read the last row of each key."""
    root = storage.new_path(spark, "twins")
    source = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source if _is_folder(spark, source) else f"{sf_dir}/events*.parquet")
    twins.run_to_table(build(stream.withColumn("ts", F.col("ts").cast("timestamp"))), f"{root}/out", f"{root}/checkpoint")
    return twins.latest(spark, f"{root}/out", *keys)


def _is_folder(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    out = _drained(spark, d, lambda s: twins.tumbling_counts(s, "user_id"), "start", "user_id")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT user_id, CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) AS start_s, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s")
def session_counts(spark, d):
    """Sessions with a gap of 30 minutes, in batch (a merged session leaves rows of its parts behind in update mode)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_seconds("w.start").alias("start_s"), "n")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS accepted FROM events")
def stateful_quota(spark, d):
    out = _drained(spark, d, lambda s: twins.stateful_quota(s.select("user_id", "event_id", "ts"), 3), "event_id")
    return out.select("event_id", "accepted")


@query("SELECT DISTINCT event_id, user_id FROM events")
def dedupe_stream(spark, d):
    out = _drained(spark, d, lambda s: twins.deduplicated(s.select("event_id", "user_id", "ts"), "event_id", late="60 days"), "event_id")
    return out.select("event_id", "user_id")


@query("SELECT event_type, count(value) AS n, true AS p50_close, true AS p95_close FROM events GROUP BY event_type")
def timing_percentiles_stream(spark, d):
    """Sketches a day from a stream, merged, and held against the exact share of values up to them: within one hundredth."""
    e = table(spark, d, "events")
    got = observe.merged_percentiles(_drained(spark, d, lambda s: twins.timing_sketches(s, "value", "event_type"), "start", "event_type"), "event_type")
    share = lambda p, op: F.count_if(F.expr(f"value {op} {p}")) / F.count("value")
    close = lambda p, at: ((share(p, "<") <= at + 0.01) & (share(p, "<=") >= at - 0.01)).alias(f"{p}_close")
    return e.join(got.withColumnRenamed("n", "seen"), "event_type").groupBy("event_type").agg(F.max("seen").alias("n"), close("p50", 0.5), close("p95", 0.95))


def _landed(spark, df, build, mode="update"):
    """Land ``df`` as files, drain the stream built over them, and give the sink's rows."""
    root = storage.new_path(spark, "machines")
    df.write.parquet(f"{root}/in")
    machines.drain(build(spark.readStream.schema(df.schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/checkpoint", mode)
    return f"{root}/out"


#: Seconds of the derived tables as moments; a row at the epoch itself would count as late.
_START = 1_000_000_000


def _moment(seconds):
    return F.timestamp_seconds(F.col(seconds) + _START)


@query(SQL["otp_window"])
def otp_send_stream(spark, d):
    rows = _SENDS.df(spark, d).select("user_id", "event_id", _moment("sec").alias("at"))
    out = _landed(spark, rows, lambda s: machines.otp_sends(s, "user_id", "event_id", "at"))
    return machines.committed(spark, out).select(F.col("user").alias("user_id"), F.col("request").alias("event_id"), "sent", "retry_after_s")


@query(SQL["otp_verify"])
def otp_verify_stream(spark, d):
    rows = _TRIES.df(spark, d).select("code_id", "event_id", _moment("sec").alias("at"), _moment("issued").alias("issued_at"), "ok")
    out = _landed(spark, rows, lambda s: machines.otp_verify(s, "code_id", "event_id", "at", "ok", "issued_at"))
    return machines.committed(spark, out).select(F.col("code").alias("code_id"), F.col("attempt").alias("event_id"), "verdict")


@query(SQL["session_counts"])
def session_stream(spark, d):
    """Sessions from a stream of files in any order; merged ones are retracted."""
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = _landed(spark, rows, lambda s: machines.sessions(s.withColumnRenamed("user_id", "key"), "key", "at", late="60 days"))
    found = twins.latest(spark, out, "key", "start_us").filter("n > 0")
    return found.select(F.col("key").alias("user_id"), F.floor(F.col("start_us") / 1_000_000).alias("start_s"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def audit_stream(spark, d):
    """An audit trail through the sink that holds each batch once; the first batch arrives twice."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    out = _landed(spark, events, lambda s: s, "append")
    machines.once(out)(events, 0)
    return machines.committed(spark, out)
