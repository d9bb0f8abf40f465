"""A split by few groups does not shuffle its rows, and a fit cuts its texts into words once."""

from lexloom.operators import datasets, learn
from pyspark.sql import functions as F


def test_few_groups_meet_rows_by_broadcast(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("g"), F.col("id") % 7).alias("source"))
    split = datasets.group_split(rows, "source").select("id", "split")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the rows are too many for Spark to choose it
    try:
        plan = split._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [source" in plan and "SortMergeJoin [source" not in plan
    assert split.count() == 2000 and {r.split for r in split.select("split").distinct().collect()} <= {"train", "val", "test"}


def test_fit_reads_stored_terms(spark, monkeypatch):
    kept = []
    stored = learn.storage.stored
    monkeypatch.setattr(learn.storage, "stored", lambda df, tag: kept.append((tag, df.columns)) or stored(df, tag))
    rows = spark.createDataFrame([(i, "alpha beta" if i % 2 else "gamma delta", "ab"[i % 2]) for i in range(40)], "id int, text string, lang string")
    got = learn.train_and_predict(rows.filter("id < 30"), rows.filter("id >= 30"), "lang").collect()
    assert kept == [("terms", ["__label", "__tf"])]
    assert len(got) == 10 and all(r.predicted == r.lang for r in got)
