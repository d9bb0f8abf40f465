"""Pages to clauses: heading detection, breadcrumbs, token-budgeted packing and merging of small pieces.

One document is the unit of order, so every window is partitioned by it; nothing is ordered globally.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import fixed, text

Counter = Callable[[DataFrame, list[str], str, str], DataFrame]


def explode_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_number, line) from (doc_id, page_number, text); line_no counts from 1."""
    rows = pages.select("doc_id", "page_number", F.posexplode(text.lines(F.col("text"))).alias("k", "line"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "k")
    return rows.select("doc_id", F.row_number().over(order).alias("line_no"), "page_number", "line")


def detect_headings(lines: DataFrame) -> DataFrame:
    """Adds ``level`` (null for body lines).

    A "(N)" line counts if the line before it ends a sentence, is a heading, or is missing. The recursion runs
    only inside a run of "(N)" lines, so it is a running maximum over the run.
    """
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    hard = text.heading_level(F.col("line"), F.lit(False))
    is_n = F.col("line").rlike(fixed.PAREN_NUMBER)
    df = lines.withColumn("hard", hard).withColumn("is_n", is_n)
    df = df.withColumn("before", F.lag("line").over(doc)).withColumn("hard_before", F.lag("hard").over(doc))
    base = F.col("before").isNull() | text.ends_sentence(F.col("before")) | F.col("hard_before").isNotNull()
    df = df.withColumn("run", F.sum(F.when(F.col("is_n"), 0).otherwise(1)).over(doc)).withColumn("base", base)
    in_run = Window.partitionBy("doc_id", "run").orderBy("line_no")
    accepted = F.max(F.col("is_n") & F.col("base")).over(in_run)
    level = F.when(F.col("is_n"), F.when(accepted, 2)).otherwise(F.col("hard"))
    return df.withColumn("level", level.cast("int")).select(*lines.columns, "level")


def _opened(stack: list[tuple[int, str]], level: int, title: str) -> str:
    """The path after a heading, which closes those of its level or deeper."""
    while stack and stack[-1][0] >= level:
        stack.pop()
    stack.append((level, title))
    return " > ".join(title for _, title in stack) or fixed.UNTITLED


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``heading_path`` of lines sorted by document and place: a stack of open headings, carried from batch to batch.

    A heading closes those of its level or deeper. Only the stack is held, however long a document is.
    """
    doc, stack, path = None, [], fixed.UNTITLED
    for batch in batches:
        docs, levels, titles = (batch.column(c).to_pylist() for c in ("doc_id", "level", "__title"))
        paths = []
        for k, level in enumerate(levels):
            if k == 0 and docs[k] != doc or k > 0 and docs[k] != docs[k - 1]:
                stack, path = [], fixed.UNTITLED
            if level is not None:
                path = _opened(stack, level, titles[k])
            paths.append(path)
        doc = docs[-1] if docs else doc
        kept = [c for c in batch.schema.names if c != "__title"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(paths, pa.string())], names=[*kept, "heading_path"])


def _doc_paths(headings: pa.Array) -> pa.Array:
    """The same for documents as rows: ``heading_path`` of each of a document's candidates, from their (level, title) in order."""
    out = []
    for doc in headings.to_pylist():
        stack: list[tuple[int, str]] = []
        out.append([fixed.UNTITLED if h["level"] is None else _opened(stack, h["level"], h["title"]) for h in doc])
    return pa.array(out, pa.list_(pa.string()))


def breadcrumbs(lines: DataFrame) -> DataFrame:
    """Adds ``candidate`` (headings so far) and ``heading_path`` ("A > B").

    The ancestor at level k is the last heading of level k or less, if its level is k: what a stack of open headings holds.
    The plan is the same at any depth, and nothing runs while it is made.
    """
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    df = lines.withColumn("candidate", F.count("level").over(doc).cast("int"))
    schema = StructType([*df.schema.fields, StructField("heading_path", StringType())])
    titled = df.withColumn("__title", F.when(F.col("level").isNotNull(), F.col("line")))
    return titled.repartition("doc_id").sortWithinPartitions("doc_id", "line_no").mapInArrow(_paths, schema)


def _pack(sentences: Column, budget: int) -> Column:
    """Greedy packing of structs (page, text, n): a piece is closed when the next sentence does not fit."""
    none = F.array().cast("array<struct<page:int,text:string,n:int>>")
    start = F.struct(none.alias("done"), F.lit(None).cast("struct<page:int,text:string,n:int>").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        fits = acc["cur"].isNotNull() & (acc["cur"]["n"] + s["n"] <= budget)
        joined = F.struct(acc["cur"]["page"].alias("page"), F.concat(acc["cur"]["text"], F.lit(" "), s["text"]).alias("text"), (acc["cur"]["n"] + s["n"]).alias("n"))
        done = F.when(acc["cur"].isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(s).alias("cur"))

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def size_candidates(lines: DataFrame, budget: int = fixed.MAX_TOKENS, counter: Counter | None = None) -> DataFrame:
    """(doc_id, candidates): one row a document; candidates in order, each with heading_path and pieces. One within the budget is whole, others go by sentences.

    ``lines`` are those of ``detect_headings``, whose partitions by document serve every step: nothing is shuffled again. ``counter`` adds counts
    to rows with arrays of texts; without one, the offline counter runs in the projection.
    """
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("candidate", F.count("level").over(doc).cast("int")).groupBy("doc_id", "candidate")
    rows = rows.agg(
        F.sort_array(F.collect_list(F.struct("line_no", F.col("page_number").cast("int").alias("page"), "line"))).alias("ls"),
        F.max("level").alias("level"),  # a candidate has one heading at most, its first line
    )
    whole = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    first = F.get("ls", F.lit(0))
    heading = F.struct("level", F.when(F.col("level").isNotNull(), first["line"]).alias("title"))
    of_page = lambda p: text.sentences(F.array_join(F.transform(F.filter("ls", lambda x: x["page"] == p), lambda x: x["line"]), " "))
    pages = F.array_distinct(F.transform("ls", lambda x: x["page"]))
    count = (lambda t: [text.token_count(t).alias("n")]) if counter is None else (lambda t: [])
    by_page = F.transform(pages, lambda p: F.transform(of_page(p), lambda s: F.struct(p.alias("page"), s.alias("text"), *count(s))))
    rows = rows.select("doc_id", "candidate", heading.alias("heading"), "ls", whole.alias("whole"))
    if counter is None:
        rows = rows.withColumn("n", text.token_count(F.col("whole")))
    # a token is a byte at least, so what has few bytes needs no sentences; the whole is unit 0
    long = F.octet_length("whole") > budget if counter else F.col("n") > budget
    single = F.array(F.struct(first["page"].alias("page"), F.col("whole").alias("text"), *([] if counter else [F.col("n")])))
    units = F.when(long, F.concat(single, F.flatten(by_page))).otherwise(single)
    rows = rows.select("doc_id", F.struct("candidate", "heading", units.alias("units")).alias("c"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    paths = F.arrow_udf(_doc_paths, ArrayType(StringType()))
    docs = docs.withColumn("paths", paths(F.transform("cs", lambda c: c["heading"])))
    if counter is not None:
        texts = F.transform("cs", lambda c: F.transform(c["units"], lambda u: u["text"]))
        docs = counter(docs.withColumn("texts", texts), ["doc_id"], "texts", "ns").drop("texts")

    def pieces(units: Column) -> Column:
        return F.when(F.get(units, F.lit(0))["n"] <= budget, F.slice(units, 1, 1)).otherwise(_pack(F.slice(units, F.lit(2), F.size(units)), budget))

    with_counts = lambda c, ns: F.zip_with(c["units"], ns, lambda u, n: F.struct(u["page"].alias("page"), u["text"].alias("text"), n.alias("n")))
    sized = F.transform("cs", lambda c: c["units"]) if counter is None else F.zip_with("cs", "ns", with_counts)
    docs = docs.select("doc_id", "paths", F.transform(sized, pieces).alias("pieces"))
    return docs.select("doc_id", F.zip_with("paths", "pieces", lambda h, p: F.struct(h.alias("heading_path"), p.alias("pieces"))).alias("candidates"))


_CHUNK = "struct<heading_path:string,text:string,page:int,n:int>"


def _merge(chunks: Column, least: int, most: int) -> Column:
    """Small chunks go into the one before, else into the one after, if the sum stays within ``most``.

    One fold from left to right: ``wait`` is a small chunk that did not fit backwards.
    """
    empty = F.array().cast(f"array<{_CHUNK}>")
    start = F.struct(empty.alias("out"), F.lit(None).cast(_CHUNK).alias("wait"))

    def join(a: Column, b: Column, heading: Column, page: Column) -> Column:
        return F.struct(heading.alias("heading_path"), F.concat(a["text"], F.lit("\n"), b["text"]).alias("text"), page.alias("page"), (a["n"] + b["n"]).alias("n"))

    def place(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        back = (F.size(out) > 0) & (last["n"] + x["n"] <= most)
        merged = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(join(last, x, last["heading_path"], last["page"])))
        keep = x["n"] >= least
        return F.struct(
            F.when(keep, F.concat(out, F.array(x))).when(back, merged).otherwise(out).alias("out"),
            F.when(keep | back, F.lit(None).cast(_CHUNK)).otherwise(x).alias("wait"),
        )

    def step(acc: Column, x: Column) -> Column:
        ahead = acc["wait"].isNotNull() & (acc["wait"]["n"] + x["n"] <= most)
        out = F.when(acc["wait"].isNull() | ahead, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["wait"])))
        now = F.when(ahead, join(acc["wait"], x, x["heading_path"], acc["wait"]["page"])).otherwise(x)
        both = F.struct(out.alias("out"), now.alias("x"))
        return F.get(F.transform(F.array(both), lambda b: place(b["out"], b["x"])), F.lit(0))

    folded = F.aggregate(chunks, start, step, lambda acc: F.when(acc["wait"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["wait"]))))
    return F.when(F.size(chunks) <= 1, chunks).otherwise(folded)


def chunk_documents(pages: DataFrame, budget: int = fixed.MAX_TOKENS, least: int = fixed.MIN_TOKENS, counter: Counter | None = None) -> DataFrame:
    """(doc_id, chunk_ord, heading_path, text, page_number, n_tokens) from (doc_id, page_number, text).

    ``counter`` (such as ``tokens.counted``) adds counts to rows that hold nested arrays of texts: (rows, keys, text, out).
    """
    docs = size_candidates(detect_headings(explode_lines(pages)), budget, counter)
    of = lambda c: F.transform(c["pieces"], lambda p: F.struct(c["heading_path"].alias("heading_path"), p["text"].alias("text"), p["page"].alias("page"), p["n"].alias("n")))
    docs = docs.select("doc_id", F.flatten(F.transform("candidates", of)).cast(f"array<{_CHUNK}>").alias("chunks"))
    out = docs.select("doc_id", F.posexplode(_merge(F.col("chunks"), least, budget)).alias("chunk_ord", "c"))
    return out.select("doc_id", "chunk_ord", F.col("c.heading_path").alias("heading_path"), F.col("c.text").alias("text"), F.col("c.page").alias("page_number"), F.col("c.n").alias("n_tokens"))
