"""Line-first quality cleaning, in DataFrame functions only.

Every line is judged by itself, in this order: *symbols* (a tenth or more of its characters are markup
symbols), *navigation* (three separators or more with three words or fewer between them, as in menus),
*punctuation* (shouting: an exclamation mark for every second word or more; or a fragment of up to three words
without an end mark, unless it is an item of a list or in a script that is written without spaces), *boilerplate*
(phrases of page furniture in the languages of ``PHRASES``, a parameter). Failing lines are removed. A document
that loses more than ``max_loss`` of its characters by this is rejected, and so is one that fails the base
rules: fewer than ``min_words`` words, or over ``max_repeat`` percent of its words in repeated 5-word
windows. Blank lines neither fail nor count.

Words are runs of characters other than space and \\t-\\r. Repeated windows are first looked for by a 64-bit hash;
only texts in which a hash repeats are decided by sorting the windows themselves, so the count is exact
and costs n log n for a text of n words. All of it is one projection: no shuffle, no Python.

Cases: null text is empty (no words, so rejected); repeated rows are judged row by row; other columns pass
through, also if they have the names of the statistics (``clean`` returns only the columns of the input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT = 20
WINDOW = 5
MAX_LOSS = 0.5

BLANKS = " \t\n\u000b\f\r"
_GAP = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
_SEPARATOR = r"[|»›•·]"
_END = r"""[.!?:;…"'”’»)\]。！？]$"""
_ITEM = r"^(?:[-*•–]|[0-9]+[.)])[\x20\x09]"
_UNSPACED = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}]{4}"

#: Page furniture by language, as patterns; word boundaries are added on both sides.
PHRASES = {
    "en": (
        "all rights reserved", "terms of (?:use|service)", "privacy policy", "cookie policy", "uses? cookies", "enable javascript", "click here", "read more",
        "skip to (?:main )?content", "sign (?:in|up)", "log ?in", "subscribe (?:now|to)", "share (?:this|on)", "powered by",
    ),
    "de": ("alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl.rung", "impressum", "verwendet cookies", "mehr lesen", "weiterlesen", "jetzt anmelden"),
    "fr": ("tous droits r.serv.s", "conditions d.utilisation", "mentions l.gales", "utilise des cookies", "lire la suite", "en savoir plus", "se connecter"),
    "es": ("todos los derechos reservados", "aviso legal", "utiliza cookies", "leer m.s", "iniciar sesi.n", "suscr.bete"),
}


def phrase_pattern(phrases: dict[str, tuple[str, ...]]) -> str:
    """One pattern of all languages."""
    return r"(?i)\b(?:" + "|".join(p for language in phrases.values() for p in language) + r")\b"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column, phrases: dict[str, tuple[str, ...]] = PHRASES) -> Column:
    """Whether a line fails; blank lines don't."""
    furniture = phrase_pattern(phrases)

    def judge(bare: Column) -> Column:
        n_words = F.size(F.split(bare, _GAP))
        symbols = bare.rlike(_SYMBOL) & (10 * _count(bare, _SYMBOL) >= F.length(F.regexp_replace(bare, _GAP, "")))
        separators = _count(bare, _SEPARATOR)
        navigation = bare.rlike(_SEPARATOR) & (separators >= 3) & (n_words <= 4 * separators + 3)
        shouting = bare.contains("!") & (_count(bare, "!") >= 3) & (2 * _count(bare, "!") >= n_words)
        fragment = (n_words <= 3) & ~bare.rlike(_END) & ~bare.rlike(_ITEM) & ~bare.rlike(_UNSPACED)
        return (bare != "") & (symbols | navigation | shouting | fragment | bare.rlike(furniture))

    return _let(F.btrim(line, F.lit(BLANKS)), judge)


def _covered(words: Column, n: Column, window: int) -> Column:
    """Words inside windows that occur twice or more: sort the windows, then join up their places."""
    windows = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.struct(F.array_join(F.slice(words, i + 1, window), " ").alias("s"), i.alias("i")))

    def places(by_text: Column) -> Column:
        twice = F.filter(by_text, lambda x, i: (F.get(by_text, i + 1)["s"] == x["s"]) | ((i > 0) & (F.get(by_text, F.greatest(i - 1, F.lit(0)))["s"] == x["s"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def width(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return _let(_let(F.sort_array(windows), places), width)


def judge(documents: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, max_loss: float = MAX_LOSS, phrases: dict[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """The columns of ``documents`` in a struct ``row``, the statistics, the verdict and the clean text."""
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    df = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"))
    df = df.select("row", text.alias("body")).select("row", "body", words_of(F.col("body")).alias("words"), F.split("body", "\n").alias("lines"))
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(WINDOW))))
    judged = F.transform("lines", lambda x: F.struct(x.alias("line"), F.length(F.btrim(x, F.lit(BLANKS))).cast("long").alias("size"), line_fails(x, phrases).alias("fails")))
    df = df.select("row", "body", "words", F.when(n >= WINDOW, hashes).alias("hashes"), judged.alias("judged"))
    lost = F.aggregate("judged", F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], x["size"]).otherwise(0))
    total = F.aggregate("judged", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    worded = F.transform(F.filter("judged", lambda x: x["size"] > 0), lambda x: x["line"])
    repeats = F.when(F.col("hashes").isNull() | (F.size(F.array_distinct("hashes")) == F.size("hashes")), F.lit(0).cast("long")).otherwise(_covered(F.col("words"), n, WINDOW))
    df = df.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("body"), _SYMBOL).cast("long").alias("n_symbols"),
        _let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        lost.alias("lost_chars"),
        total.alias("line_chars"),
        F.array_join(F.transform(F.filter("judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    # the partition id keeps filters on the verdict above the projections: pushed into them, they would compute
    # words and windows over again inside every lambda
    df = df.withColumn("base_failed", failed & (F.spark_partition_id() >= 0))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_loss * F.col("line_chars")))


def clean(documents: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **limits) -> DataFrame:
    """Kept documents with their clean text, in the columns of ``documents`` (``chars_col`` is counted anew)."""
    out = judge(documents, text_col, **limits).filter("kept")
    new = {text_col: F.col("clean_text")}
    if chars_col in documents.columns:
        new[chars_col] = F.length("clean_text").cast(documents.schema[chars_col].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in documents.columns))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "line_chars")
