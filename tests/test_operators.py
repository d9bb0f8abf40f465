"""Folds, sources and providers against plain Python, and hand-made edge cases."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.functions import fixed, text
from lexloom.operators import classify, providers, quota, retrieve, segment
from lexloom.sources import files
from lexloom.sources import json as json_source


def merge(sizes, least=fixed.MIN_TOKENS, most=fixed.MAX_TOKENS):
    """The definition: revisit after every merge; backwards first, else forwards."""
    out, i = list(sizes), 0
    if len(out) <= 1:
        return out
    while i < len(out):
        if out[i] < least and i > 0 and out[i - 1] + out[i] <= most:
            out[i - 1 : i + 1] = [out[i - 1] + out[i]]
        elif out[i] < least and i + 1 < len(out) and out[i] + out[i + 1] <= most:
            out[i : i + 2] = [out[i] + out[i + 1]]
        else:
            i += 1
    return out


def test_merge_is_the_definition(spark):
    rng = random.Random(7)
    cases = [[rng.choice((1, 5, 20, 39, 40, 250, 480, 500, 512, 700)) for _ in range(rng.randrange(0, 9))] for _ in range(400)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ns array<int>")
    chunks = F.transform("ns", lambda n: F.struct(F.lit("h").alias("heading_path"), F.lit("t").alias("text"), F.lit(1).alias("page"), n.alias("n")))
    got = df.select("i", F.transform(segment._merge(chunks.cast(f"array<{segment._CHUNK}>"), fixed.MIN_TOKENS, fixed.MAX_TOKENS), lambda c: c["n"]).alias("m"))
    assert {r.i: list(r.m) for r in got.collect()} == {i: merge(c) for i, c in enumerate(cases)}


def test_chunks_keep_all_words_and_the_ceiling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page_number"), "text")
    chunks = segment.chunk_documents(docs)
    words = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum(text.token_count(F.col("text"))).alias("n")).collect() if r.n}
    assert words(chunks) == words(docs)
    longest = chunks.filter(F.col("n_tokens") > fixed.MAX_TOKENS).filter(F.size(text.sentences(F.col("text"))) > 1)
    assert longest.count() == 0


def test_bm25_of_one_scope_ignores_others(spark):
    items = [("a", 1, "red green"), ("a", 2, "red red blue"), ("b", 3, "green green green")]
    q = spark.createDataFrame([(1, "green blue")], "query_id int, text string")
    every = spark.createDataFrame(items, "scope string, item_id int, text string")
    alone = every.filter("scope = 'a'")
    pick = lambda df: sorted(tuple(r) for r in retrieve.bm25(q, df).filter("scope = 'a'").collect())
    assert pick(every) == pick(alone)


def test_fixed_floor_pace(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(60)) for k in range(20) for i in range(12)]
    got = quota.fixed_floor_pace(spark.createDataFrame(rows, "k int, i int, at long"), "k", "i", "at").collect()
    for k in range(20):
        last = None
        for r in sorted((r for r in got if r.k == k), key=lambda r: (r["at"], r.i)):
            last = r["at"] if last is None else max(r["at"], last + 3)
            assert r.start_s == last


def test_cascade_embeds_only_what_the_lexicon_leaves(spark):
    seen = []

    def embed(df):
        seen.append({r.clause_id for r in df.select("clause_id").collect()})
        return providers.hashed_embedding(df)

    clauses = spark.createDataFrame([(1, "Termination", "x"), (2, "Other", "indemnify and hold harmless"), (3, None, "")], "clause_id int, heading_path string, text string")
    centroids = providers.hashed_embedding(spark.createDataFrame([("Indemnification", "indemnify and hold harmless")], "category string, text string")).withColumnRenamed("embedding", "centroid")
    out = {r.clause_id: r.category for r in classify.cascade(clauses, embed, centroids).collect()}
    assert out == {1: "Termination", 2: "Indemnification", 3: None} and seen == [{2, 3}]


def test_embedding_cache(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, text string")
    none = spark.createDataFrame([], "model string, text_sha string, embedding array<float>")
    done, fresh = providers.cached(rows, none, "m", providers.hashed_embedding)
    assert done.count() == 3 and fresh.count() == 2
    again, more = providers.cached(rows, fresh, "m", providers.hashed_embedding)
    assert again.count() == 3 and more.count() == 0


def docx(*paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_extract_pages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("First", "Second"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Page one) Tj ET\nendstream\nstream\n(Page \\(two\\)) Tj\nendstream")
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "d.txt").write_bytes(b"text")
    (tmp_path / "e.pdf").write_bytes(b"")
    checked = files.validate_upload(files.read_binary(spark, str(tmp_path)))
    verdicts = {r.path.rsplit("/", 1)[1]: r.verdict for r in checked.select("path", "verdict").collect()}
    assert verdicts == {"a.docx": "ok", "b.pdf": "ok", "c.docx": "ok", "d.txt": "unsupported"}  # the scan skips e.pdf
    pages = files.extract_pages(checked.filter("verdict = 'ok'")).collect()
    got = sorted((r.path.rsplit("/", 1)[1], r.page_number, r.text, r.status.split(":")[0]) for r in pages)
    assert got == [("a.docx", 1, "First\nSecond", "ok"), ("b.pdf", 1, "Page one", "ok"), ("b.pdf", 2, "Page (two)", "ok"), ("c.docx", 1, "", "failed")]


def _hangs(content):
    import subprocess
    import time

    subprocess.Popen(["sleep", "600"])
    time.sleep(600)


def _crashes(content):
    import os

    os._exit(9)


def _one_bad_page(content):
    return ["first", lambda: 1 / 0, lambda: "third \ud800"]


def test_extraction_survives_hanging_and_crashing_parsers(spark):
    import time

    rows = [(f"{k}{n}", b"x", k) for n in range(2) for k in ("hang", "crash", "bad", "fine", "error")]
    parsers = {"hang": _hangs, "crash": _crashes, "bad": _one_bad_page, "fine": lambda c: [c.decode()], "error": lambda c: [1 / 0]}
    df = spark.createDataFrame(rows, "path string, content binary, kind string").repartition(2)
    start = time.time()
    got = {(r.path, r.page_number): (r.text, r.status) for r in files.extract_pages(df, parsers, timeout_s=2).collect()}
    assert time.time() - start < 60
    for n in "01":
        assert got["hang" + n, 1] == ("", "timeout") and got["crash" + n, 1] == ("", "crashed") and got["fine" + n, 1] == ("x", "ok")
        assert got["error" + n, 1] == ("", "failed: ZeroDivisionError")
        assert [got["bad" + n, k] for k in (1, 2, 3)] == [("first", "ok"), ("", "ok"), ("third ?", "ok")]


def test_deflated_and_broken_streams():
    import zlib

    good = zlib.compress(b"BT (Packed page) Tj ET")
    content = b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\n" + good + b"\nendstream\n<< /Filter /FlateDecode >>\nstream\nnot deflated\nendstream\nstream\n(Plain) Tj\nendstream"
    pages = files.plain_pdf_pages(content)
    assert pages[0]() == "Packed page" and pages[2]() == "Plain"
    with pytest.raises(zlib.error):
        pages[1]()


def test_short_strata(spark):
    from lexloom.operators import datasets

    rows = spark.createDataFrame([(k, "a" if k < 5 else "b") for k in range(8)], "id int, kind string")
    targets = spark.createDataFrame([("a", 2), ("b", 4), ("c", 1)], "kind string, target int")
    with pytest.raises(ValueError, match="kind=b, target=4, available=3"):
        datasets.stratified_sample(rows, targets.filter("kind <> 'c'"), ["kind"], "id")
    got = [(r.kind, r.short) for r in datasets.stratified_sample(rows, targets, ["kind"], "id", allow_short=True).collect()]
    assert sorted(got) == [("a", False)] * 2 + [("b", True)] * 3
    assert sorted((r.kind, r.available) for r in datasets.short_strata(rows, targets, ["kind"]).collect()) == [("b", 3), ("c", 0)]


def test_centroids_are_built_again_only_for_changed_examples(spark):
    from lexloom.operators import providers

    asked = []

    def embed(df):
        asked.extend(r.text for r in df.collect())
        return providers.hashed_embedding(df)

    examples = spark.createDataFrame([("x", "one text"), ("x", "two texts"), ("y", "other")], "category string, text string")
    none = spark.createDataFrame([], "model string, category string, examples_sha string, centroid array<double>")
    first, cache = providers.centroids(examples, none, "m", embed)
    want = {r.category: r.centroid for r in first.collect()}
    assert sorted(asked) == ["one text", "other", "two texts"] and set(want) == {"x", "y"}
    asked.clear()
    kept = spark.createDataFrame(cache.collect(), cache.schema)
    changed = examples.filter("text <> 'other'").unionByName(spark.createDataFrame([("y", "new")], examples.schema))
    again, fresh = providers.centroids(changed, kept, "m", embed)
    got = {r.category: r.centroid for r in again.collect()}
    assert asked == ["new"] and got["x"] == want["x"] and got["y"] != want["y"] and [r.category for r in fresh.collect()] == ["y"]


def test_stored_index_and_tables(spark, tmp_path):
    from lexloom.operators import contracts

    path = f"file://{tmp_path}/index"
    v = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0])], "scope string, item_id int, embedding array<float>")
    contracts.store_index(v, path)
    contracts.store_index(spark.createDataFrame([("b", 3, [3.0])], v.schema), path)
    assert sorted((r.scope, r.item_id) for r in contracts.load_index(spark, path).collect()) == [("a", 1), ("b", 3)]
    one = contracts.load_index(spark, path, "b")
    assert [r.item_id for r in one.collect()] == [3] and "PartitionFilters: [scope" in one._jdf.queryExecution().toString().replace("isnotnull(scope#", "scope#")
    name = "grown_table"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        contracts.ensure_table(spark, name, {"id": "INT"})
        spark.sql(f"INSERT INTO {name} VALUES (1)")
        contracts.ensure_table(spark, name, {"id": "INT", "note": "STRING"})
        contracts.ensure_table(spark, name, {"note": "STRING"})
        assert [tuple(r) for r in spark.table(name).collect()] == [(1, None)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_containing(spark):
    from lexloom.operators import evaluate

    texts = ["", "a", "xa b c dy e", "one two three four five six seven", "two three", " two  three ", "say: one two three four five six seven!", None, "b c"]
    parts = ["a b c d", "two three", "three", "ne two three four five six sev", "one two three four five six seven", "b c", "", "zzz", "o"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    passages = spark.createDataFrame(list(enumerate(parts)), "j int, passage string")
    got = sorted(tuple(r) for r in evaluate.containing(rows, "body", passages, "passage", "i", "j").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(parts) if t is not None and p and p in t)


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": "y"}\n{broken\n')
    rows = json_source.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int").collect()
    assert [(r.id, r.n, r._bad is not None) for r in rows] == [("x", 1, False), ("y", None, False), (None, None, True)]
    qas = [{"id": "c__Termination", "is_impossible": False, "answers": [{"text": "x " * 30, "answer_start": 3}, {"text": "short", "answer_start": 0}]}, {"id": "c__Venue", "answers": [{"text": "y " * 30, "answer_start": 1}]}]
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "ctx", "qas": qas}]}]}))
    from lexloom.operators import datasets

    flat = datasets.flatten_answers(json_source.read_answers(spark, str(tmp_path / "s.json"))).collect()
    assert [(r.contract, r.category, len(r.text)) for r in flat] == [("t", "Termination", 59)]


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    json_source.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    json_source.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


@pytest.mark.parametrize("line,after,want", [("1. A", True, 1), ("1.2 A", True, 2), ("1.2.3", True, 3), ("Section 4.1 x", True, 2), ("ARTICLE IV", True, 1), ("(i) x", True, 3), ("(c) x", True, 2), ("(v) x", True, 3), ("(12) x", True, 2), ("(12) x", False, None), ("AB", True, None), ("ABC", True, 1), ("A B C D E F G H I", True, None), ("plain", True, None)])
def test_heading_levels(spark, line, after, want):
    got = spark.range(1).select(text.heading_level(F.lit(line), F.lit(after)).alias("x")).first().x
    assert got == want


def test_contract_entry_points(spark, tmp_path):
    from lexloom.operators import contracts

    rows = spark.createDataFrame([(1, "c1"), (2, "c2")], "id int, contract_id string")
    flags = spark.createDataFrame([(1, "c1", "low"), (2, "c2", "high")], "clause_id int, contract_id string, severity string")
    audit = spark.createDataFrame([(1, "c1"), (2, "c2")], "clause_id int, contract_id string")
    after = contracts.delete_clauses(spark.createDataFrame([(1,)], "clause_id int"), rows, flags, audit)
    assert [r.id for r in after["clauses"].collect()] == [2] and [r.clause_id for r in after["flags"].collect()] == [2]
    assert sorted((str(r.clause_id), r.contract_id) for r in after["audit"].collect()) == [("2", "c2"), ("None", "c1")]
    n, rest = contracts.delete_counted(rows, spark.createDataFrame([("c1",), ("x",)], "contract_id string"), "contract_id")
    assert n == 1 and rest.count() == 1
    assert contracts.append_audit(audit, str(tmp_path / "audit")) and not contracts.append_audit(audit, "nofs://x/y")
    old = contracts.read_evolved(spark, str(tmp_path / "audit"), {"details": "string", "clause_id": "int"})
    assert old.columns == ["clause_id", "contract_id", "details"]
    shown = spark.range(1).select(contracts.prompt(F.lit("c"), F.array(F.lit("a"), F.lit("b"))).alias("p")).first().p
    assert shown == "Clause:\nc\n\nRelated clauses:\na\n\nb"
    items = spark.createDataFrame([("s", 1, "pay the fee", [1.0, 0.0], "Termination"), ("s", 2, "pay the fine", [0.9, 0.1], None)], "scope string, item_id int, text string, embedding array<float>, category string")
    found = contracts.grounding(rows, items, spark.createDataFrame([(1, "high"), (2, "low")], "item_id int, severity string")).collect()
    assert {r.query_id for r in found} == {1} and [r.item_id for r in sorted(found, key=lambda r: r.rank)] == [1, 2]


def test_knn_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(("a", "b")[i % 2], i, [rng.random() for _ in range(4)]) for i in range(120)]
    items = spark.createDataFrame(rows, "scope string, item_id int, embedding array<float>")
    q = items.filter("item_id < 10").withColumnRenamed("item_id", "query_id")
    pick = lambda: sorted(tuple(r) for r in retrieve.knn(q, items, 5).select("query_id", "item_id", "rank").collect())
    small = pick()
    monkeypatch.setattr(retrieve, "SMALL_VECTORS", 0)
    assert pick() == small and len(small) == 50
