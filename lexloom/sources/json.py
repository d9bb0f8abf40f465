"""JSON and JSONL sources and sinks, with row and field errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

LABELLED = "contract_id STRING, clause_id STRING, category STRING, alternate_category STRING, is_risky BOOLEAN, severity STRING, query STRING, notes STRING"
ANSWERS = (
    "data ARRAY<STRUCT<title STRING, paragraphs ARRAY<STRUCT<context STRING, qas ARRAY<STRUCT<id STRING, is_impossible BOOLEAN,"
    " answers ARRAY<STRUCT<text STRING, answer_start INT>>>>>>>>"
)
_UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return validate_labelled(spark.read.schema(LABELLED).option("multiLine", True).json(path))


def validate_labelled(rows: DataFrame) -> DataFrame:
    """Adds ``errors``: "field: reason" for each bad field, empty for valid rows."""
    categories = (*fixed.CATEGORIES, "Unclassified")
    checks = {
        "contract_id: not a uuid": ~F.coalesce(F.col("contract_id").rlike(_UUID), F.lit(False)),
        "clause_id: not a uuid": ~F.coalesce(F.col("clause_id").rlike(_UUID), F.lit(False)),
        "category: not allowed": ~F.coalesce(F.col("category").isin(*categories), F.lit(False)),
        "alternate_category: not allowed": F.col("alternate_category").isNotNull() & ~F.col("alternate_category").isin(*categories),
        "is_risky: missing": F.col("is_risky").isNull(),
        "severity: not allowed": ~F.coalesce(F.col("severity").isin(*fixed.SEVERITIES), F.lit(False)),
        "query: empty": F.coalesce(F.length("query"), F.lit(0)) == 0,
    }
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(bad, reason) for reason, bad in checks.items()))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are ignored, broken ones give a row of nulls with ``_bad``."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWERS).option("multiLine", True).json(path)


def write_jsonl(rows: DataFrame, path: str, *partition_by: str) -> None:
    """One folder a split, nulls left out."""
    rows.write.partitionBy(*partition_by).option("ignoreNullFields", True).mode("overwrite").json(path)


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Replace what is stored for the keys that occur in ``rows``; other keys stay."""
    rows.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def response(*columns: str):
    """JSON of a row, nulls left out."""
    return F.to_json(F.struct(*columns))
