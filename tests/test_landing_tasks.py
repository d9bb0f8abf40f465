"""A landing folder of many small files: few triggers, and parsing spread over tasks."""

from pyspark.sql import functions as F

from lexloom.sources import files
from lexloom.streaming import machines


def test_small_files_are_dealt_to_all_cores(spark, tmp_path):
    """Also where Spark may put small partitions together, as it does by default."""
    sizes = spark.range(2000).select(F.concat(F.lit("/in/"), F.col("id")).alias("path"), F.lit(100).cast("long").alias("length"))
    ranges = files.page_ranges(sizes).select(F.spark_partition_id().alias("task"))
    assert ranges.groupBy().agg(F.count_distinct("task")).first()[0] >= spark.sparkContext.defaultParallelism


def test_triggers_do_not_follow_the_number_of_small_files(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    content = F.encode(F.concat(F.lit("%PDF-1.4\nstream\n("), F.col("id").cast("string"), F.lit(") Tj\nendstream")), "UTF-8")
    assert files.write_files(spark.range(1200).select(F.concat("id", F.lit(".pdf")).alias("name"), content.alias("content")), folder) == 1200
    machines.drain(files.landing_pages(spark, folder), out, str(tmp_path / "checkpoint"), "append")
    got = spark.read.parquet(out)
    assert sorted(r.text for r in got.collect()) == sorted(map(str, range(1200)))
    assert got.select("batch").distinct().count() == 1
