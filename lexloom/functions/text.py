"""Text as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.WORD), F.lit(0))


def token_count(text: Column) -> Column:
    """The offline token counter: words and single other characters."""
    return F.coalesce(F.regexp_count(text, F.lit(fixed.TOKEN)), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces after . ! ? and before a capital or an opening bracket."""
    parts = F.split(strip(text), r"(?<=[.!?])\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def ends_sentence(text: Column) -> Column:
    return strip(text).rlike(fixed.SENTENCE_END)


def heading_level(line: Column, after_sentence: Column) -> Column:
    """Level of a heading line, null for others. ``after_sentence`` matters to "(N)" lines only."""
    words = F.size(F.split(line, r"\s+"))
    dots = F.length(F.regexp_extract(line, fixed.SECTION, 1)) - F.length(F.replace(F.regexp_extract(line, fixed.SECTION, 1), F.lit("."), F.lit("")))
    return (
        F.when(line.rlike(fixed.NUMBER_3), 3)
        .when(line.rlike(fixed.NUMBER_2), 2)
        .when(line.rlike(fixed.SECTION), 1 + dots)
        .when(line.rlike(fixed.ARTICLE), 1)
        .when(line.rlike(fixed.NUMBER_1), 1)
        .when(line.rlike(fixed.PAREN_ROMAN), 3)
        .when(line.rlike(fixed.PAREN_LETTER), 2)
        .when(line.rlike(fixed.PAREN_NUMBER), F.when(after_sentence, 2))
        .when((words <= 8) & line.rlike(fixed.CAPITALS), 1)
    )


def normal_heading(text: Column) -> Column:
    """Without up to three leading numbering tokens and trimmed of separators, lower case."""
    out = strip(text)
    for _ in range(3):
        out = strip(F.regexp_replace(out, fixed.LEADING_NUMBER, ""))
    return F.lower(F.regexp_replace(F.btrim(out, F.lit(fixed.HEADING_TRIM)), r"\s+", " "))


def phrase_at(text: Column, phrase: str) -> Column:
    """1-based place of a phrase between word boundaries, 0 for none."""
    return F.regexp_instr(text, F.lit(rf"\b{phrase}\b"))


def heading_proxy(context: Column) -> Column:
    """Last line with text among the characters before a span; the one before it where that is long."""
    found = F.filter(F.transform(F.split(F.right(context, F.lit(fixed.HEADING_LOOKBACK)), "\n"), strip), lambda x: x != "")
    long = (F.length(F.get(found, F.size(found) - 1)) > fixed.LONG_LINE) & (F.size(found) >= 2)
    return F.coalesce(F.when(long, F.get(found, F.size(found) - 2)).otherwise(F.get(found, F.size(found) - 1)), F.lit(""))


def alnum_ratio(text: Column) -> Column:
    shown = F.regexp_replace(text, r"\s", "")
    return F.try_divide(F.length(F.regexp_replace(shown, r"[^\p{L}\p{N}]", "")), F.length(shown))


def longest_alpha_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def page_verdict(text: Column, confidence: Column) -> Column:
    """Why recognised text of a page is refused, or ``ok``."""
    bare = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(bare == "", "empty")
        .when(confidence.isNull(), "no confidence")
        .when(confidence < fixed.MIN_CONFIDENCE, "low confidence")
        .when(alnum_ratio(bare) < fixed.MIN_ALNUM_RATIO, "few letters")
        .when(longest_alpha_run(bare) < fixed.MIN_ALPHA_RUN, "no word")
        .otherwise("ok")
    )


def content_ref(text: Column, digits: int = 12) -> Column:
    return F.left(F.sha2(text, 256), F.lit(digits))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
