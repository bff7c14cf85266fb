"""Text functions as column expressions.

Java's character classes are ASCII unless ``(?U)`` is given, and ``trim`` drops
blanks only; the patterns here follow Unicode white space instead.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = "(?U)[\\s\\x1c-\\x1f]+"
OMITTED = "[OMITTED]"

# Code points that the normalisation folds or drops.
TATWEEL = "ـ"
ALEF_FORMS, ALEF = "أإآٱ", "ا"
ALEF_MAQSURA, YEH = "ى", "ي"
ARABIC_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
DIACRITICS = "[\\u064B-\\u065F\\u0670]"
ARABIC_BLOCK = "[\\u0600-\\u06FF]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: str | Column) -> Column:
    """Compatibility composition, the one text step that Spark lacks; ASCII text never leaves the JVM's value as it is."""
    c = col(c)
    return F.when(c.rlike("[^\\x00-\\x7F]"), _compatible(c)).otherwise(c)


def strip(c: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z", "")


def squeeze(c: str | Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def fold_letters(c: str | Column) -> Column:
    """Drops the lengthening stroke, and folds alef forms, final yeh and Arabic digits."""
    # translate() drops source characters beyond the end of the target
    return F.translate(col(c), ALEF_FORMS + ALEF_MAQSURA + ARABIC_DIGITS + TATWEEL, ALEF * len(ALEF_FORMS) + YEH + DIGITS)


def normalize(c: str | Column, strip_diacritics: bool = False, compose: bool = True) -> Column:
    """The normal form for matching; null gives an empty string.  ``compose=False`` skips NFKC and stays in the JVM."""
    c = F.coalesce(col(c), F.lit(""))
    out = squeeze(fold_letters(nfkc(c) if compose else c))
    return F.regexp_replace(out, DIACRITICS, "") if strip_diacritics else out


def tokens(c: str | Column, letters: str = "\\w\\u0600-\\u06FF") -> Column:
    """Runs of the given letters.  Punctuation of the Arabic block counts as letters and stays on its word."""
    return F.array_remove(F.split(F.coalesce(col(c), F.lit("")), f"(?U)[^{letters}]+"), "")


def words(c: str | Column) -> Column:
    """Whitespace-separated words, in order."""
    return F.array_remove(F.split(F.coalesce(col(c), F.lit("")), SPACE), "")


def word_set(c: str | Column) -> Column:
    return F.array_distinct(words(c))


def contains(c: str | Column, part: str | Column) -> Column:
    """Literal containment; false for nulls, true for an empty part."""
    return F.coalesce(F.contains(col(c), col(part)), F.lit(False))


def remove_all(c: str | Column, part: str | Column) -> Column:
    """Without any occurrence; an empty or null part removes nothing."""
    c, part = col(c), F.coalesce(col(part), F.lit(""))
    return F.when(part == "", c).otherwise(F.replace(c, part, F.lit("")))


def remove_first(c: str | Column, part: str | Column) -> Column:
    """Without the first occurrence; an empty or null part removes nothing."""
    c, part = col(c), F.coalesce(col(part), F.lit(""))
    at = F.position(part, c)
    return F.when((part != "") & (at > 0), F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(part), F.length(c)))).otherwise(c)


def has_script(c: str | Column, block: str = ARABIC_BLOCK) -> Column:
    return F.coalesce(col(c).rlike(block), F.lit(False))


# Old and variant label names and the names they stand for.
LABEL_NAMES = {
    "Definiteness": "Definiteness Shift",
    "Definiteness Shift": "Definiteness Shift",
    "Formality Level": "Register Mismatch",
    "Register Mismatch": "Register Mismatch",
    "Terminological Substitution": "Terminology Substitution",
    "Terminology Substitution": "Terminology Substitution",
    "Negation": "Tense Shift Under Negation",
    "Tense shift under negation": "Tense Shift Under Negation",
    "Tense Shift Under Negation": "Tense Shift Under Negation",
    "Wrong Word Order": "Wrong Word Order",
    "Adjective to Noun": "Adjective to Noun",
    "Total Omission": "Total Omission",
}


def map_values(c: Column, names: dict[str, str]) -> Column:
    """Known values replaced by what they stand for, others as they are."""
    if not names:
        return c
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), c)


def normalize_label(c: str | Column, names: dict[str, str] = LABEL_NAMES) -> Column:
    """White space squeezed, invisible characters dropped, then variants mapped."""
    shown = F.regexp_replace(squeeze(c), "[\\p{C}\\p{Zl}\\p{Zp}&&[^ ]]|[\\p{Zs}&&[^ ]]", "")
    return map_values(strip(shown), {k.strip(): v for k, v in names.items()})


def null_like(c: str | Column, extra: tuple[str, ...] = ()) -> Column:
    c = col(c)
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan", "none", *extra)


def anchor_or_omitted(c: str | Column) -> Column:
    """Null-like anchors as the sentinel for "no counterpart"."""
    return F.when(null_like(c), F.lit(OMITTED)).otherwise(strip(c))


def anchor_or_empty(c: str | Column) -> Column:
    """Null-like anchors and the sentinel as an empty string."""
    return F.when(null_like(c, (OMITTED.lower(),)), F.lit("")).otherwise(strip(c))


def span(c: str | Column, start: str | Column, end: str | Column) -> Column:
    """The stripped text from one character offset to another (exclusive); null where they don't make a span."""
    start, end = col(start), col(end)
    return F.when((start >= 0) & (end >= start), strip(F.substring(col(c), start + 1, end - start)))


def char_to_token_span(starts: str | Column, ends: str | Column, start: str | Column, end: str | Column) -> Column:
    """First and last index of the tokens (arrays of offsets) that a character span touches; null where none does."""
    starts, ends, start, end = col(starts), col(ends), col(start), col(end)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(starts) - 1, F.lit(0))), lambda i: (F.get(starts, i) < end) & (F.get(ends, i) > start))
    return F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("first"), F.array_max(at).alias("last")))


def fold_category(c: str | Column, beginning: str = "style", name: str = "Style & Register") -> Column:
    return F.when(F.startswith(F.lower(strip(c)), F.lit(beginning)), F.lit(name)).otherwise(col(c))


def json_object(c: str | Column, schema: str) -> Column:
    """The JSON object between the first and the last brace of a text; null where there is none or it can't be read."""
    found = F.regexp_extract(col(c), "(?s)\\{.*\\}", 0)
    return F.when(found != "", F.from_json(found, schema))


# Beginnings that answers put before a label.
BEGINNINGS = ("the error is", "error class:", "error type:", "answer:", "class:")


def parse_label(c: str | Column, labels: list[str], beginnings: tuple[str, ...] = BEGINNINGS) -> Column:
    """The first label, in the list's order, that an answer holds; then its first line; else "Unknown"."""
    raw = F.coalesce(col(c), F.lit(""))
    text = F.regexp_replace(strip(F.lower(raw)), "^[\"'.*\\n]+|[\"'.*\\n]+\\z", "")
    for b in beginnings:
        text = F.regexp_replace(text, "^" + re.escape(b) + "(?U)\\s*", "")
    known = F.array(*(F.lit(x) for x in labels))
    line = F.lower(strip(F.element_at(F.split(raw, "\n"), 1)))
    first = F.get(F.filter(known, lambda x: F.contains(text, F.lower(x))), F.lit(0))
    second = F.get(F.filter(known, lambda x: F.contains(line, F.lower(x))), F.lit(0))
    return F.coalesce(first, second, F.lit("Unknown"))


def shorten(c: str | Column, short: dict[str, str]) -> Column:
    """Chained literal replacements, for labels in reports."""
    out = col(c)
    for long, name in short.items():
        out = F.replace(out, F.lit(long), F.lit(name))
    return out
