"""Filters, joins, aggregates, listings and mutations over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets, evaluate, observe, report
from .base import SQL, Derived, Inline, query, table


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND length(text) >= 40")
def scan_filter_pushdown(spark, d):
    return table(spark, d, "documents").filter((F.col("lang") == "en") & (F.length("text") >= 40)).select("doc_id", "lang", "n_chars")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def ownership_scope_semi(spark, d):
    owners = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return report.owned(table(spark, d, "orders").select("o_orderkey", "o_custkey"), owners, "o_custkey", "c_mktsegment", "BUILDING")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_filter(spark, d):
    done = table(spark, d, "labels").withColumn("label_status", F.when(F.col("quality") == 1, "ok").otherwise("failed"))
    return datasets.resume(table(spark, d, "documents").select("doc_id", "lang"), done, "doc_id")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'error') AND ts >= (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY user_id")
def quota_window_count(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.date_trunc("DAY", F.max("ts").cast("timestamp")).alias("since"))
    return e.join(F.broadcast(last), F.col("ts").cast("timestamp") >= F.col("since")).filter(F.col("event_type").isin("click", "error")).groupBy("user_id").agg(F.count("*").alias("n"))


_ERRORS = Derived("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS severity, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS explanation, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS citation FROM documents")


@query(f"SELECT id, concat_ws(',', CASE WHEN severity IS NULL THEN 'severity' END, CASE WHEN explanation IS NULL THEN 'explanation' END, CASE WHEN citation IS NULL THEN 'citation' END) AS missing FROM {_ERRORS.sql}")
def missing_fields(spark, d):
    return datasets.missing_fields(_ERRORS.df(spark, d), "severity", "explanation", "citation").select("id", "missing")


@query("SELECT o_orderkey, o_orderpriority, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def flag_join_ordered(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    j = o.join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_orderkey", "o_orderpriority", "l_linenumber", "l_partkey").orderBy("o_orderkey", "l_linenumber")


_SEVERITY = "CASE WHEN l_returnflag = 'R' THEN 'high' WHEN l_returnflag = 'A' THEN 'medium' WHEN l_linestatus = 'F' THEN 'needs_manual_review' WHEN l_quantity > 45 THEN 'flagging_failed' ELSE 'low' END"


def _flags(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.expr(_SEVERITY).alias("severity"))


@query(
    f"""WITH f AS (SELECT l_orderkey, {_SEVERITY} AS s FROM lineitem)
    SELECT o_orderkey, o_orderstatus, count(*) FILTER (s IN ('high', 'medium')) AS clauses_flagged,
      count(*) FILTER (s IN ('needs_manual_review', 'flagging_failed')) AS clauses_needs_review, count(*) FILTER (s = 'low') AS clauses_no_flag
    FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY 1, 2"""
)
def severity_pivot_summary(spark, d):
    return report.with_summary(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), _flags(spark, d), "o_orderkey")


@query(f"SELECT severity, count(*) AS n FROM (SELECT {_SEVERITY} AS severity FROM lineitem) GROUP BY 1")
def severity_counts(spark, d):
    return _flags(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


_BUCKET = """CASE WHEN s = 'needs_manual_review' THEN 'needs_manual_review' WHEN s <> 'low' THEN 'flagged' WHEN low THEN 'possible_risk' ELSE 'no_flag' END"""


@query(
    f"""WITH b AS (SELECT {_BUCKET} AS bucket FROM (SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 'needs_manual_review' WHEN toxic = 1 THEN 'high' ELSE 'low' END AS s, quality = 0 AS low FROM labels))
    SELECT bucket, count(*) AS n, CAST(floor(100.0 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent FROM b GROUP BY bucket"""
)
def bucket_proportions(spark, d):
    rows = table(spark, d, "labels")
    severity = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "needs_manual_review").when(F.col("toxic") == 1, "high").otherwise("low")
    return report.proportions(rows.select(report.bucket(severity, F.col("quality") == 0).alias("bucket")))


@query(
    """SELECT pill, n FROM (SELECT unnest(['toxic', 'poor', 'both', 'clean', 'any', 'none']) AS pill,
      unnest([count(*) FILTER (toxic = 1), count(*) FILTER (quality = 0), count(*) FILTER (toxic = 1 AND quality = 0), count(*) FILTER (toxic = 0 AND quality = 1), count(*) FILTER (toxic = 1 OR quality = 0), count(*) FILTER (toxic > 1)]) AS n FROM labels) WHERE n > 0"""
)
def summary_pills(spark, d):
    t, q = F.col("toxic"), F.col("quality")
    return report.pills(table(spark, d, "labels"), {"toxic": t == 1, "poor": q == 0, "both": (t == 1) & (q == 0), "clean": (t == 0) & (q == 1), "any": (t == 1) | (q == 0), "none": t > 1})


_PAGE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40"


@query(_PAGE)
def paged_listing(spark, d):
    return report.page(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 20, 40).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(f"SELECT count(*) AS contracts, count(*) FILTER (o_orderstatus = 'P') AS processing, round(sum(o_totalprice), 2) AS total FROM ({_PAGE})")
def stat_strip(spark, d):
    return paged_listing(spark, d).agg(F.count("*").alias("contracts"), F.count_if(F.col("o_orderstatus") == "P").alias("processing"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    f"""SELECT o_orderkey, l_linenumber, severity, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'needs_manual_review' THEN 2 WHEN 'flagging_failed' THEN 3 ELSE 4 END AS INTEGER) AS severity_rank
    FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, {_SEVERITY} AS severity FROM lineitem)"""
)
def severity_rank_sort(spark, d):
    return _flags(spark, d).withColumn("severity_rank", report.severity_rank(F.col("severity"))).orderBy("severity_rank", "o_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return report.cascade_delete(gone, "l_orderkey", {"lines": table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")})["lines"]


@query("SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN NULL ELSE user_id END AS user_id FROM events")
def set_null_delete(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return report.set_null_delete(e, e.filter("event_type = 'error'"), "user_id").select("event_id", "user_id")


@query(
    """SELECT user_id, arg_max(event_id, ROW(ts, event_id)) AS event_id, arg_max(value, ROW(ts, event_id)) AS value FROM events GROUP BY user_id"""
)
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("v"))
    return report.upsert(e.filter("event_id < 500"), e.filter("event_id >= 500"), "user_id", "v").select("user_id", "event_id", "value")


@query("SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS current_stage FROM events GROUP BY user_id")
def stage_current(spark, d):
    return report.current_stage(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


_STATUS = Derived(
    """SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'extracting' WHEN 1 THEN 'chunking' WHEN 2 THEN 'embedding' WHEN 3 THEN 'flagging' WHEN 4 THEN 'complete' WHEN 5 THEN 'persisting' END AS stage,
    CASE user_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'processing' END AS status FROM events"""
)


@query(
    f"""SELECT id, CASE WHEN status = 'failed' THEN coalesce(stage, 'failed') WHEN status = 'complete' THEN 'complete' ELSE stage END AS terminal,
    CASE WHEN stage IS NULL AND status IN ('complete', 'failed') THEN status ELSE stage END AS backfilled,
    CAST(list_position(['extracting', 'chunking', 'persisting', 'embedding', 'flagging', 'complete'], stage) - 1 AS BIGINT) AS progress FROM {_STATUS.sql}"""
)
def stage_writes(spark, d):
    s, t = F.col("stage"), F.col("status")
    return _STATUS.df(spark, d).select("id", report.terminal_stage(s, t).alias("terminal"), report.backfill_stage(s, t).alias("backfilled"), report.progress_index(s).alias("progress"))


@query("SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def timing_percentiles(spark, d):
    return observe.percentiles(table(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query(SQL["timing_percentiles"])
def timing_percentiles_selected(spark, d):
    """The same by bracket and count, for keys too large for one group."""
    return observe.selected_percentiles(table(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query("SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p95")
def timing_percentiles_empty(spark, d):
    return observe.percentiles(table(spark, d, "events").filter("value > 1e300"), "value").select("n", "p50", "p95")


_LOG = Derived(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'no timing here' WHEN 1 THEN 'TIMING {broken' WHEN 2 THEN concat('TIMING {"stage": "', event_type, '", "duration_ms": "12", "timestamp": "x"}')
    WHEN 3 THEN concat('INFO TIMING {"stage": "', event_type, '", "duration_ms": ', event_id % 500, '.5, "timestamp": "2024-01-01T00:00:00+00:00", "n_candidates": ', user_id, '}  ')
    WHEN 4 THEN concat('TIMING {"stage": "', event_type, '", "duration_ms": ', event_id, ', "timestamp": "2024-01-02T03:04:05+00:00", "contract_id": "c', user_id, '"}') ELSE concat('TIMING ', props) END AS value FROM events"""
)


@query(f"SELECT regexp_extract(value, '\"stage\": \"(\\w+)\"', 1) AS stage, CASE WHEN event_id % 6 = 3 THEN event_id % 500 + 0.5 ELSE event_id END::DOUBLE AS duration_ms, CASE WHEN event_id % 6 = 4 THEN regexp_extract(value, 'c\\d+') END AS contract_id, CASE WHEN event_id % 6 = 3 THEN CAST(regexp_extract(value, 'n_candidates\": (\\d+)', 1) AS INTEGER) END AS n_candidates FROM {_LOG.sql} WHERE event_id % 6 IN (3, 4)")
def timing_log_parse(spark, d):
    return observe.parse_timing(_LOG.df(spark, d)).select("stage", "duration_ms", "contract_id", "n_candidates")


@query(
    """WITH b AS (SELECT toxic = 1 AS a, quality = 0 AS p FROM labels), c AS (SELECT count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM b)
    SELECT tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c"""
)
def precision_recall(spark, d):
    return evaluate.binary_confusion(table(spark, d, "labels").select((F.col("toxic") == 1).alias("a"), (F.col("quality") == 0).alias("p")), "a", "p")


_CITED = Derived("SELECT doc_id AS id, text AS body, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN concat('no such words', doc_id) WHEN 3 THEN left(text, 40) ELSE replace(substr(text, 10, 60), ' ', '  ') END AS citation FROM documents")


@query(f"SELECT id, coalesce(trim(regexp_replace(citation, '\\s+', ' ', 'g')), '') <> '' AND contains(trim(regexp_replace(body, '\\s+', ' ', 'g')), coalesce(trim(regexp_replace(citation, '\\s+', ' ', 'g')), '')) AS resolved FROM {_CITED.sql}")
def citation_resolved_edges(spark, d):
    return _CITED.df(spark, d).select("id", evaluate.citation_resolved(F.col("body"), F.col("citation")).alias("resolved"))


@query("SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY b.item_id")
def citation_resolved(spark, d):
    """Which benchmark passages occur in documents, after white space is evened out."""
    docs = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("body"))
    items = table(spark, d, "benchmark").select("item_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("passage"))
    hits = evaluate.containing(docs, "body", items, "passage", "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


_SEV = Derived(
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS a, CASE l_linenumber % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS b FROM lineitem"""
)


@query(f"SELECT l_orderkey, l_linenumber, CASE abs(list_position(['low', 'medium', 'high'], a) - list_position(['low', 'medium', 'high'], b)) WHEN 0 THEN 'EXACT' WHEN 1 THEN 'CLOSE' ELSE 'FAR' END AS closeness, a <> 'low' AS flagged FROM {_SEV.sql}")
def severity_closeness(spark, d):
    return _SEV.df(spark, d).select("l_orderkey", "l_linenumber", evaluate.severity_closeness(F.col("a"), F.col("b")).alias("closeness"), (F.col("a") != "low").alias("flagged"))


@query("SELECT min(doc_id) AS doc_id, sha256(concat(lang, chr(1), text)) AS key FROM documents GROUP BY lang, text")
def exact_dedup_first(spark, d):
    key = F.concat(F.col("lang"), F.lit("\u0001"), F.col("text"))
    return datasets.first_of_each(table(spark, d, "documents").select("doc_id", "lang", "text"), key, "doc_id").select("doc_id", F.sha2(key, 256).alias("key"))


@query(
    """WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('42' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
    SELECT d.doc_id, d.source, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM documents d JOIN g USING (source)"""
)
def group_split(spark, d):
    return datasets.group_split(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "split")


_TARGETS = Inline("lang string, target int", ("en", 12), ("de", 5), ("fr", 100000))


@query(
    f"""SELECT doc_id, lang, format('{{}}_{{:04d}}', lang, k - 1) AS sample_id, target > n AS short FROM (SELECT doc_id, lang, target, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id), doc_id) AS k FROM documents JOIN {_TARGETS.sql} USING (lang)) WHERE k <= target"""
)
def stratified_sample(spark, d):
    return datasets.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), _TARGETS.df(spark), ["lang"], "doc_id", allow_short=True).select("doc_id", "lang", "sample_id", "short")


_LABELS = Derived("SELECT CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'flagging_failed' WHEN 'view' THEN 'odd' WHEN 'signup' THEN NULL ELSE 'ok' END AS status FROM events")


@query(
    f"""WITH c AS (SELECT coalesce(status, 'UNKNOWN') AS status, count(*) AS n FROM {_LABELS.sql} GROUP BY 1), k AS (SELECT unnest(['ok', 'flagging_failed', 'needs_manual_review']) AS status)
    SELECT status, coalesce(n, 0) AS n, k.status IS NOT NULL AS expected FROM k FULL JOIN c USING (status)"""
)
def status_counts(spark, d):
    return datasets.status_counts(_LABELS.df(spark, d), "status")


@query(
    """WITH RECURSIVE g AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY source),
    f AS (SELECT CAST(0 AS BIGINT) AS k, [0.0::DOUBLE, 0.0, 0.0] AS have, CAST(NULL AS VARCHAR) AS source, 0 AS pick
      UNION ALL SELECT k, list_transform(have, lambda h, i: h + CASE WHEN i = pick THEN n ELSE 0 END), source, pick FROM (
        SELECT g.k, g.source, g.n, have, list_position(gaps, list_max(gaps)) AS pick FROM (SELECT f.k AS before, f.have, list_transform([0.7::DOUBLE, 0.15, 0.15], lambda s, i: round(s * t.total - f.have[i], 6)) AS gaps FROM f, (SELECT any_value(total) AS total FROM g) t) JOIN g ON g.k = before + 1))
    SELECT source, ['train', 'val', 'test'][pick] AS split FROM f WHERE k > 0"""
)
def deficit_assign(spark, d):
    groups = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return datasets.deficit_assign(groups, "source", "n", {"train": 0.7, "val": 0.15, "test": 0.15})


@query(
    """WITH RECURSIVE g AS (SELECT l_partkey AS part, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, CAST(l_partkey AS VARCHAR)) AS k FROM lineitem GROUP BY l_partkey),
    f AS (SELECT CAST(0 AS BIGINT) AS k, [0.0::DOUBLE, 0.0, 0.0] AS have, CAST(NULL AS BIGINT) AS part, 0 AS pick
      UNION ALL SELECT k, list_transform(have, lambda h, i: h + CASE WHEN i = pick THEN n ELSE 0 END), part, pick FROM (
        SELECT g.k, g.part, g.n, have, list_position(gaps, list_max(gaps)) AS pick FROM (SELECT f.k AS before, f.have, list_transform([0.7::DOUBLE, 0.15, 0.15], lambda s, i: round(s * t.total - f.have[i], 6)) AS gaps FROM f, (SELECT any_value(total) AS total FROM g) t) JOIN g ON g.k = before + 1))
    SELECT CAST(part AS VARCHAR) AS part, ['train', 'val', 'test'][pick] AS split FROM f WHERE k > 0"""
)
def deficit_assign_parts(spark, d):
    """Very many groups: each part's lines stay together."""
    groups = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return datasets.deficit_assign(groups, "part", "n", {"train": 0.7, "val": 0.15, "test": 0.15})


_GRID = "(SELECT * FROM (VALUES ('src0'), ('src1'), ('none')) a(source), (VALUES ('en'), ('de'), ('xx')) b(lang))"


@query(f"SELECT g.source, g.lang, count(d.doc_id) AS n, count(d.doc_id) < 5 AS thin FROM {_GRID} g LEFT JOIN documents d ON g.source = d.source AND g.lang = d.lang GROUP BY 1, 2")
def split_report(spark, d):
    return datasets.split_report(table(spark, d, "documents"), "source", "lang", ["src0", "src1", "none"], ["en", "de", "xx"])


@query("SELECT lang, count(DISTINCT source) AS n_sources, count(*) AS n FROM documents GROUP BY lang")
def distinct_groups(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n"))
