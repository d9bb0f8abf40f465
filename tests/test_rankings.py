"""The evaluation's rankings: what several of them use is made once."""

from pyspark.sql import functions as F

from lexloom.plans import retrieval


def test_letters_in_one_pass(spark):
    texts = [(1, "Straße der ÄPFEL, z"), (2, ""), (3, None), (4, "日本 aaa 😀"), (5, "K İ k")]
    df = spark.createDataFrame(texts, "item_id long, text string")
    want = {r.item_id: r.e for r in df.select("item_id", retrieval._letters(F.lower("text")).alias("e")).collect()}
    got = {r.item_id: r.embedding for r in retrieval._lettered(df, "item_id").collect()}
    assert got.pop(3) is None and set(want.pop(3)) == {None}
    assert got == want


def test_rankings_are_made_once(spark, sf_dir):
    """No text is cut into words by the plan of the rates: it only reads stored rankings and the truth."""
    plan = retrieval.hit_at_k(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents" not in plan
