"""Extraction of many pages in bounded pieces."""

import pyarrow as pa

from lexloom.sources import files


def test_pages_of_a_batch_leave_in_pieces(spark, monkeypatch):
    """A batch of files gives its pages on as they come, so a task never holds all of them."""
    monkeypatch.setattr(files, "HELD_CHARS", 100)
    rows = [(f"{i}.pdf", b"%PDF-1.4\nstream\n(" + b"x" * 30 + b") Tj\nendstream", "pdf") for i in range(40)]
    frame = spark.createDataFrame(rows, "path string, content binary, kind string")
    run = None

    class Seen:
        columns = frame.columns

        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            nonlocal run
            run = work

    files.extract_pages(Seen())
    batch = pa.RecordBatch.from_pylist([dict(zip(frame.columns, r)) for r in rows])
    pieces = list(run(iter([batch])))
    assert sum(p.num_rows for p in pieces) == 40 and max(p.num_rows for p in pieces) == 4
    assert {t for p in pieces for t in p.column("text").to_pylist()} == {"x" * 30}
