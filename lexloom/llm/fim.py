"""Fill-in-middle rearrangement of texts, in Spark SQL functions only.

A text is matched from left to right into units (``regexp_extract_all``; one code point each unless another pattern is
given), two cuts drawn from a hash of the document id make prefix, middle and suffix (``slice``, ``array_join``), and the
parts are written behind sentinels in one of two orders: psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
``restore`` splits an arranged text at its sentinels and puts the parts back in their places.

Draws: ``conv`` of the first four groups of 8 hex digits of sha256("<seed>:<id>"): two cuts, then whether the text is
arranged at all, then the order. A text that holds a sentinel is left plain, since it could not be told apart; no sentinel
overlaps another or itself, so cuts next to ``<`` or ``>`` cannot make one.

Cases: null and empty texts are plain and come back empty; a null id draws as the empty string; rows that repeat an id
draw alike, each for its own length; a cut may fall at either end and two cuts may meet, so each part may be empty; with a pattern that does not
match everything, what lies between matches is lost, so patterns must cover the text (``whole`` tells whether they did:
where they did not, the text stays plain); long texts are arrays of their units in one row; an empty table gives an empty table; other columns pass
through untouched in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point, line ends included.
CODE_POINT = r"(?s)."
SEED = "1"
#: Per cent of texts that are arranged, and of these in the order spm.
ARRANGED, SPM = 90, 20


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def arrange(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = CODE_POINT,
    seed: str = SEED,
    arranged: int = ARRANGED,
    spm: int = SPM,
) -> DataFrame:
    """(row, n, form, prefix_units, middle_units, output): every row of ``docs``, which is whole in ``row``."""
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"row.{id_col}").cast("string"), F.lit(""))), 256)
    cut = docs.select(F.struct("*").alias("row")).select("row", text.alias("text"), digest.alias("digest"))
    cut = cut.select("row", "text", "digest", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("units"))
    cut = cut.withColumn("n", F.size("units").cast("long"))
    first, second = _draw(F.col("digest"), 0) % (F.col("n") + 1), _draw(F.col("digest"), 1) % (F.col("n") + 1)
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(sentinel))
    whole = F.lit(True) if pattern == CODE_POINT else F.array_join("units", "") == F.col("text")
    plain = (F.col("text") == "") | marked | (_draw(F.col("digest"), 2) % 100 >= arranged) | ~whole
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < spm, "spm").otherwise("psm")
    cut = cut.select("row", "text", "units", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))

    def part(start: Column, stop: Column) -> Column:
        return F.array_join(F.slice("units", (start + 1).cast("int"), (stop - start).cast("int")), "")

    moved = F.col("form") != "plain"
    prefix = F.concat(F.lit(PREFIX), part(F.lit(0), F.col("a")))
    middle = F.concat(F.lit(MIDDLE), part(F.col("a"), F.col("b")))
    suffix = F.concat(F.lit(SUFFIX), part(F.col("b"), F.col("n")))
    output = F.when(~moved, F.col("text")).when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    return cut.select(
        "row",
        "n",
        "form",
        F.when(moved, F.col("a")).alias("prefix_units"),
        F.when(moved, F.col("b") - F.col("a")).alias("middle_units"),
        output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that was arranged: a split at the sentinels gives the parts in the order of ``form``."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    return (
        F.when(form == "psm", F.concat(parts.getItem(1), parts.getItem(3), parts.getItem(2)))
        .when(form == "spm", F.concat(parts.getItem(2), parts.getItem(3), parts.getItem(1)))
        .otherwise(output)
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, arranged and restored."""
    done = arrange(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
