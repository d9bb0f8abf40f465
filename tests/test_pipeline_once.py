"""The clause pipeline cuts documents once: its tables read stored clauses."""

from lexloom.operators import pipeline


def test_tables_read_stored_clauses(spark):
    pages = spark.createDataFrame([(1, 1, "1. Governing Law\nThe laws apply."), (2, 1, None)], "doc_id int, page_number int, text string")
    centroids = spark.createDataFrame([("x", [1.0] * 64)], "category string, centroid array<double>")
    out = pipeline.run_pipeline(pages, centroids)
    for df in (out.clauses, out.vectors, out.flags):
        assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.heading_path) for r in out.clauses.collect()] == [(1, "1. Governing Law")]
    assert out.flags.count() == out.vectors.count() == 1
