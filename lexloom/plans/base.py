"""Registry of queries with their SQL, and inline tables that both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files have fewer splits than that (one small file); large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Derived:
    """Input of an operator made from the whole tables by one SQL text that both engines read. A table's name inside a string is only a word."""

    def __init__(self, body: str):
        self.body, self.sql = body, f"({body})"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        pieces = re.split(r"('(?:[^']|'')*')", self.body.replace("{", "{{").replace("}", "}}"))  # every second piece is a string
        names = re.compile(rf"\b({'|'.join(_TABLES)})\b")
        used = {t for piece in pieces[::2] for t in names.findall(piece)}
        body = "".join(piece if k % 2 else names.sub(r"{\1}", piece) for k, piece in enumerate(pieces))
        return spark.sql(body, **{t: table(spark, sf_dir, t) for t in used})


class Inline:
    """A small fixed table, as a DataFrame and as a SQL subquery."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, list(rows)
        self.names = [c.strip().split()[0] for c in schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS v({', '.join(self.names)}))"
