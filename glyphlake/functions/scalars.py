"""Column functions that Spark does not have under these semantics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity; ``round`` takes them away from zero."""
    return F.floor(x + F.lit(0.5))


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted array; 1 for an empty one or a zero."""
    at = F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
    return F.coalesce(F.when(F.size(values) > 0, F.nullif(at, F.lit(0))), F.lit(1))


def upper_quartile(values: Column) -> Column:
    """The element at min(n - 1, floor(3 n / 4)) of the sorted array; 1 for a zero, null for an empty one."""
    place = F.least(F.size(values) - 1, F.floor(F.size(values) * 0.75)).cast("int")
    return F.when(F.size(values) > 0, F.coalesce(F.nullif(F.element_at(F.array_sort(values), place + 1), F.lit(0)), F.lit(1)))


def char_of(codepoint: Column) -> Column:
    """The character of a code point of three UTF-8 bytes (U+0800 to U+FFFF)."""
    parts = [F.shiftright(codepoint, 12) + 224, F.shiftright(codepoint, 6).bitwiseAND(F.lit(63)) + 128, codepoint.bitwiseAND(F.lit(63)) + 128]
    return F.decode(F.unhex(F.concat(*(F.lpad(F.hex(p), 2, "0") for p in parts))), "UTF-8")


def is_hangul(ch: Column) -> Column:
    """Whether the first character is a Hangul syllable."""
    return F.ascii(ch).between(HANGUL_FIRST, HANGUL_LAST)


def is_wide(text: Column) -> Column:
    """Whether any character lies beyond U+2100."""
    return F.exists(F.split(text, ""), lambda c: F.ascii(c) > 0x2100)


def wants_hangul(text: Column) -> Column:
    """Whether the text has a syllable or a compatibility letter of Hangul."""
    return text.rlike("[가-힣ㄱ-ㆎ]")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode canonical composition; ASCII passes through untouched."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def glyph_name(codepoint: Column) -> Column:
    """uniXXXX with at least four hexadecimal digits."""
    h = F.hex(codepoint)
    return F.concat(F.lit("uni"), F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h))


def xml_escape(text: Column) -> Column:
    """Every character as a hexadecimal character reference."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.concat(F.lit("&#x"), F.hex(F.ascii(c)), F.lit(";"))), "")


def css_escape(text: Column) -> Column:
    """Backslashes and single quotes escaped by a backslash."""
    return F.regexp_replace(text, r"([\\'])", r"\\$1")


def font_id(name: Column) -> Column:
    """A name of letters, digits, hyphens and underscores; MyHand if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"[^A-Za-z0-9_-]", ""), F.lit("")), F.lit("MyHand"))


def grey_css(level: Column) -> Column:
    """A grey level as #rrggbb."""
    return F.concat(F.lit("#"), F.repeat(F.lower(F.lpad(F.hex(level), 2, "0")), 3))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Whole-number grey of a colour: (77 R + 150 G + 29 B) / 256."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)
