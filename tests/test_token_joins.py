"""Token counts where the rows are: no text is shuffled for them, and arrays of texts are counted in place."""

from lexloom.operators import segment, tokens


def test_counts_of_nested_arrays(spark):
    df = spark.createDataFrame([(1, [["hello world", None], []]), (2, None), (3, [None, ["", "Zyqqwx 12"]])], "id int, t array<array<string>>")
    got = {r.id: r.n for r in tokens.counted(df, ["id"], "t", "n").collect()}
    single = tokens.counted(spark.createDataFrame([(1, "hello world"), (2, "Zyqqwx 12"), (3, None)], "id int, text string"), ["id"])
    n = {r.id: r.n_tokens for r in single.collect()}
    assert n[1] == 2 and n[2] > 2 and n[3] == 0
    assert got[1] == [[n[1], 0], []] and got[3] == [[], [0, n[2]]]
    assert got[2] == []


def test_one_shuffle_makes_clauses(spark):
    pages = spark.createDataFrame([(1, 1, "1. A\nbody"), (1, 2, "1.1 B\nmore")], "doc_id int, page_number int, text string")
    for counter in (None, tokens.counted):
        chunks = segment.chunk_documents(pages, counter=counter)
        assert chunks._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert [(r.chunk_ord, r.heading_path) for r in chunks.collect()] == [(0, "1. A > 1.1 B")]  # a small clause goes into the one after it
