"""Texts without sentences or words: the two engines agree on what is null."""

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
TEXTS = ["", " ", "   ", "\u00a0", "...", "?! -", "\u2014", None, "One. Two.", "one"]


def both(spark, folder, name):
    """Rows of the query and of its SQL over ``TEXTS``."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return got, sorted(con.sql(SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["sentence_split", "word_tokens"])
def test_blank_texts(name, spark, tmp_path):
    got, want = both(spark, tmp_path, name)
    assert got == want and any(r[-1] is None and r[1] == 0 for r in got)
