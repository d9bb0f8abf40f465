"""Entry points of the application over the shared tables, and a trained classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import fixed
from ..operators import assess, contracts, datasets, evaluate, learn, providers, quota
from ..sources import files
from ..sources import json as json_source
from ..streaming import machines
from .base import SQL, Derived, query, spread, table


def _tables(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.lit("flagging").alias("current_stage"))
    severity = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    lines = table(spark, d, "lineitem").withColumn("clause_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    flags = lines.select("clause_id", F.col("l_orderkey").alias("contract_id"), severity.alias("severity"), F.lit("e").alias("explanation"), F.lit("c").alias("citation"))
    clauses = lines.select(F.col("clause_id").alias("id"), F.col("l_orderkey").alias("contract_id"), F.lit("h").alias("heading_path"), F.col("l_linestatus").alias("text"), F.col("l_linenumber").alias("page_number"), F.col("l_linenumber").alias("chunk_ord"), F.lit(None).cast("string").alias("category"))
    return o, clauses, flags


_S = "CASE WHEN l_returnflag = 'R' THEN 'high' WHEN l_returnflag = 'A' THEN 'medium' ELSE 'low' END"


@query(
    f"""SELECT o_orderkey AS id, o_orderstatus AS status, count(l_orderkey) FILTER ({_S} IN ('high', 'medium')) AS clauses_flagged, CAST(0 AS BIGINT) AS clauses_needs_review, count(l_orderkey) FILTER ({_S} = 'low') AS clauses_no_flag
    FROM (SELECT * FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 1) LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""
)
def list_contracts(spark, d):
    o, _, flags = _tables(spark, d)
    page, _ = contracts.list_contracts(o, flags, "7", 5, 1)
    return page.select("id", "status", "clauses_flagged", "clauses_needs_review", "clauses_no_flag")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(4 AS BIGINT) AS progress, (SELECT count(*) FROM lineitem WHERE l_orderkey = 5) AS n_clauses FROM orders WHERE o_orderkey = 5")
def contract_status(spark, d):
    o, clauses, flags = _tables(spark, d)
    user = F.col("user_id")
    own = o.withColumn("user_id", F.when(F.col("id") == 5, "me").otherwise(user))
    return contracts.contract_status(own, clauses, flags, 5, "me").select("id", "status", "progress", "n_clauses")


@query(f"SELECT f.l_orderkey * 10 + f.l_linenumber AS clause_id, {_S.replace('l_returnflag', 'f.l_returnflag')} AS severity, c.l_linenumber AS page_number FROM lineitem f JOIN lineitem c ON f.l_orderkey = c.l_orderkey AND f.l_linenumber = c.l_linenumber WHERE f.l_orderkey = 5")
def flagged_clauses(spark, d):
    o, clauses, flags = _tables(spark, d)
    own = o.withColumn("user_id", F.when(F.col("id") == 5, "me").otherwise(F.col("user_id")))
    return contracts.flagged_clauses(own, clauses, flags, 5, "me").select("clause_id", "severity", "page_number")


_SPANS = Derived("SELECT source AS contract, replace(text, ' ', '  ') AS text, doc_id AS pos FROM documents")
_ROWS = Derived("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'elsewhere' ELSE source END AS contract, concat(' ', text, CASE WHEN doc_id % 7 = 0 THEN ' and more' ELSE '' END) AS text FROM documents")
_EVEN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"WITH s AS (SELECT contract, {_EVEN} AS body, min(pos) AS pos FROM {_SPANS.sql} GROUP BY ALL) SELECT r.doc_id, s.pos FROM (SELECT doc_id, contract, {_EVEN} AS body FROM {_ROWS.sql}) r JOIN s USING (contract, body)")
def first_match_join(spark, d):
    return contracts.first_match(_ROWS.df(spark, d), _SPANS.df(spark, d), "contract", "text", "pos").select("doc_id", F.col("span.pos").alias("pos"))


@query()
def trained_classifier(spark, d):
    """Language of a document by a classifier trained on other sources: macro metrics over the test sources."""
    docs = datasets.group_split(table(spark, d, "documents").select("doc_id", "source", "lang", "text"), "source")
    found = learn.train_and_predict(docs.filter("split = 'train'"), docs.filter("split = 'test'"), "lang")
    # stored, or Spark asks "is there a prediction" below the join with the splits, that is of every document
    found = storage.stored(found.select("lang", "predicted"), "predicted")
    return evaluate.per_class(found, "lang", "predicted")


_CLEAN = "regexp_replace(regexp_replace(text, '[^ -~]', '?'{}), '[()\\\\\\\\]', ' '{})"


@query(f"SELECT doc_id, CAST(1 AS INTEGER) AS page_number, {_CLEAN.format(', ' + repr('g'), ', ' + repr('g'))} AS text, 'ok' AS status FROM documents WHERE length(text) > 0")
def extract_documents(spark, d):
    """Every text as a file of one page: checked, parsed in a process of its own, cleaned."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).filter(F.length("text") > 0).withColumn("shown", F.regexp_replace(F.regexp_replace("text", "[^ -~]", "?"), r"[()\\]", " "))
    content = F.encode(F.concat(F.lit("%PDF-1.4\nstream\n("), "shown", F.lit(") Tj\nendstream")), "UTF-8")
    uploads = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), content.alias("content"), F.length(content).alias("length"))
    pages, _ = contracts.ingest(uploads)
    return pages.select(F.regexp_extract("path", r"^(-?\d+)", 1).cast("long").alias("doc_id"), "page_number", "text", "status")


@query(SQL["extract_documents"])
def ingest_stream(spark, d):
    """The same from a landing folder: half of the files, a run, the other half, and a run that resumes from the checkpoint."""
    root = storage.new_path(spark, "landing")
    docs = table(spark, d, "documents").filter(F.length("text") > 0).withColumn("shown", F.regexp_replace(F.regexp_replace("text", "[^ -~]", "?"), r"[()\\]", " "))
    content = F.encode(F.concat(F.lit("%PDF-1.4\nstream\n("), "shown", F.lit(") Tj\nendstream")), "UTF-8")
    uploads = docs.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), content.alias("content"))
    for half in (0, 1):
        files.write_files(uploads.filter(F.pmod("doc_id", F.lit(2)) == half), f"{root}/in")
        machines.drain(files.landing_pages(spark, f"{root}/in", part_bytes=4096, log=f"{root}/found"), f"{root}/out", f"{root}/checkpoint", "append")
    pages = machines.committed(spark, f"{root}/out")
    return pages.select(F.regexp_extract("path", r"/(-?\d+)\.pdf$", 1).cast("long").alias("doc_id"), "page_number", "text", "status")


#: A font of two-byte codes that are UTF-16, and a font of single bytes.
_PDF_HEAD = """%PDF-1.7
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Count 2 /Kids [7 0 R 8 0 R] /Resources << /Font << /U 4 0 R /L 5 0 R >> >> >> endobj
3 0 obj << /Length 74 >> stream
1 begincodespacerange <0000> <FFFF> endcodespacerange
1 beginbfrange <0000> <FFFF> <0000> endbfrange
endstream endobj
4 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 3 0 R >> endobj
5 0 obj << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> endobj
7 0 obj << /Type /Page /Parent 2 0 R /Contents 9 0 R >> endobj
8 0 obj << /Type /Page /Parent 2 0 R /Contents [10 0 R 11 0 R] >> endobj
"""


@query("SELECT doc_id, CAST(1 AS INTEGER) AS page_number, coalesce(text, '') AS text, 'ok' AS status FROM documents UNION ALL SELECT doc_id, 2, concat(source, ' in (', lang, ')', chr(10), 'ends'), 'ok' FROM documents")
def pdf_documents(spark, d):
    """Whole texts in any script as files with a page tree: a page of mapped codes, a line a show operator, and a page of adjusted strings in two streams."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj")))
    stream = lambda n, *body: F.concat(F.lit(f"{n} 0 obj << >> stream\n"), *body, F.lit("\nendstream endobj\n"))
    first = stream(9, F.lit("BT /U 9 Tf "), F.array_join(lines, " T*\n"), F.lit(" ET"))
    second = stream(10, F.lit("BT /L 9 Tf [("), "source", F.lit(") -300 (in) -400 (\\("), "lang", F.lit("\\051)] TJ")), stream(11, F.lit("0 -12 Td (en) Tj (ds) Tj ET"))
    content = F.encode(F.concat(F.lit(_PDF_HEAD), first, *second, F.lit("trailer << /Root 1 0 R >>")), "UTF-8")
    uploads = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), content.alias("content"), F.length(content).alias("length"))
    pages, _ = contracts.ingest(uploads)
    return pages.select(F.regexp_extract("path", r"^(-?\d+)", 1).cast("long").alias("doc_id"), "page_number", "text", "status")


@query("SELECT doc_id, source, lang, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS n_chars FROM documents")
def jsonl_round_trip(spark, d):
    """Rows written as JSONL, a folder a source, nulls left out, and read again."""
    path = storage.new_path(spark, "jsonl")
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("n_chars"), F.col("source").alias("folder"))
    json_source.write_jsonl(rows, path, "folder")
    return json_source.read_jsonl(spark, f"{path}/*", "doc_id long, source string, lang string, n_chars long").select("doc_id", "source", "lang", "n_chars")


@query("SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM events UNION ALL SELECT user_id, event_id + 1000000, 'appended' FROM events")
def replaced_and_appended(spark, d):
    """Partitions of even keys replaced, odd ones kept, and a second batch appended."""
    path = storage.new_path(spark, "replaced")
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 2).alias("even"), "user_id")
    json_source.replace_partitions(e.withColumn("version", F.lit("old")), path, "even")
    json_source.replace_partitions(e.filter("even = 0").withColumn("version", F.lit("new")), path, "even")
    more = storage.new_path(spark, "appended")
    out = spark.read.parquet(path).select("user_id", "event_id", "version")
    json_source.append(out.filter("version = 'none'"), more)
    contracts.append_audit(e.select("user_id", (F.col("event_id") + 1000000).alias("event_id"), F.lit("appended").alias("version")), more)
    return out.unionByName(spark.read.parquet(more))


@query("SELECT doc_id, concat('{\"doc_id\":', doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(',\"lang\":\"', lang, '\"') ELSE '' END, ',\"n\":', n_chars, '}') AS body FROM documents")
def json_response(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.col("n_chars").alias("n"))
    return rows.select("doc_id", json_source.response("doc_id", "lang", "n").alias("body"))


@query("SELECT lang, count(*) AS n, count(DISTINCT text) FILTER (NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id % 3 = 0)) AS fresh FROM documents d GROUP BY lang")
def embedding_cache(spark, d):
    """Embeddings for all texts; a third of the rows is in the cache, and only other texts are embedded, once each."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    old = docs.filter("doc_id % 3 = 0").select(F.lit("letters").alias("model"), F.sha2("text", 256).alias("text_sha"), F.array(F.lit(0.0)).alias("embedding")).dropDuplicates(["text_sha"])
    embed = lambda df: df.select("text_sha", "text", F.array(F.length("text").cast("double")).alias("embedding"))
    done, fresh = providers.cached(docs, old, "letters", lambda df: embed(df).drop("text"))
    new = docs.withColumn("text_sha", F.sha2("text", 256)).join(fresh.select("text_sha", F.lit(1).alias("made")), "text_sha").groupBy("lang").agg(F.count_distinct("text_sha").alias("fresh"))
    return done.groupBy("lang").agg(F.count("embedding").alias("n")).join(new, "lang", "left").select("lang", "n", F.coalesce("fresh", F.lit(0)).alias("fresh"))


@query("SELECT vec_id AS item_id, label AS scope FROM embeddings WHERE label IN (2, 5)")
def index_round_trip(spark, d):
    """Vectors stored by scope, one scope written again, and two scopes read back."""
    path = storage.new_path(spark, "index")
    v = table(spark, d, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("item_id"), "embedding")
    contracts.store_index(v, path)
    contracts.store_index(v.filter("scope = 5"), path)
    return contracts.load_index(spark, path, 2, 5).select("item_id", F.col("scope").cast("int").alias("scope"))


@query("SELECT doc_id, concat('Clause:', chr(10), text, CASE WHEN doc_id % 3 > 0 THEN concat(chr(10), chr(10), 'Related clauses:', chr(10), source, CASE WHEN doc_id % 3 = 2 THEN concat(chr(10), chr(10), lang) ELSE '' END) ELSE '' END) AS prompt FROM documents")
def prompt_text(spark, d):
    related = F.slice(F.array("source", "lang"), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    return table(spark, d, "documents").select("doc_id", contracts.prompt(F.col("text"), related).alias("prompt"))


@query("SELECT count(*) FILTER (o_custkey % 2 = 0) AS gone, count(*) FILTER (o_custkey % 2 > 0) AS kept FROM orders")
def delete_counted(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n, rest = contracts.delete_counted(orders, orders.filter("o_custkey % 2 = 0").select("o_custkey").distinct(), "o_custkey")
    return rest.agg(F.lit(n).cast("long").alias("gone"), F.count("*").alias("kept"))


@query(
    """WITH f AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 40),
    g AS (SELECT source, row_number() OVER (ORDER BY md5('42' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM f WHERE k = 1)),
    s AS (SELECT f.*, CASE WHEN g.k <= floor(n * 0.7) THEN 'train' WHEN g.k <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM f JOIN g USING (source) WHERE f.k = 1)
    SELECT a.split, b.lang, count(doc_id) AS n, count(doc_id) < 5 AS thin FROM (SELECT unnest(['train', 'val', 'test']) AS split) a CROSS JOIN (SELECT unnest(['en', 'de', 'fr', 'es', 'xx']) AS lang) b LEFT JOIN s ON s.split = a.split AND s.lang = b.lang GROUP BY 1, 2"""
)
def dataset_end_to_end(spark, d):
    """Spans of some length, first of equal ones, split by source, and the grid of what is where."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "text").filter(F.length("text") >= fixed.MIN_SPAN_CHARS)
    firsts = datasets.first_of_each(rows, F.concat(F.col("lang"), F.lit("\u0001"), F.col("text")), "doc_id")
    return datasets.split_report(datasets.group_split(firsts, "source"), "split", "lang", ["train", "val", "test"], ["en", "de", "fr", "es", "xx"])


_RULE = r"CASE WHEN regexp_matches(lower(text), '\b(unlimited|sole discretion|irrevocabl[ye]|waives? all)\b') THEN 'high' WHEN regexp_matches(lower(text), '\b(indemnif|liab|terminat|penalt)') THEN 'medium' ELSE 'low' END"


@query(
    f"""WITH open AS (SELECT doc_id, source, n_chars, text FROM documents WHERE doc_id % 4 > 0), b AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM open)
    SELECT doc_id, {_RULE} AS severity FROM b WHERE spent < 50000"""
)
def teacher_batch(spark, d):
    """What is not labelled yet, up to the budget, assessed and validated: the next batch of teacher labels."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", "text")
    done = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "ok").otherwise("flagging_failed").alias("label_status"))
    batch = quota.budget_stop(datasets.resume(docs, done, "doc_id"), "doc_id", "n_chars", 50_000, "source")
    return assess.reduce_validation(providers.assess(batch).withColumn("n", F.lit(1)), "doc_id").select("doc_id", "severity")
