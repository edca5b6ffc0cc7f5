"""Column expressions that type raw string fields (all JVM-side, no UDF)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers as a Python ``float()`` call accepts them (sign, digits, one dot,
# exponent, inf/infinity/nan), surrounded by whitespace. Spark's own cast is
# wider (it takes ``61.5d`` and ``1f``), so the text is checked first.
_NUMBER_PATTERN = (
    r"(?i)^\s*[+-]?("
    r"(\d+\.?\d*|\.\d+)(e[+-]?\d+)?"
    r"|inf|infinity|nan"
    r")\s*$"
)
# Every character Python's str.strip() removes (derived from the rule, not
# listed by hand).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# The same set as a Java regex class (\uXXXX escapes).
WS_CLASS = "[" + "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE) + "]"
# Unicode decimal digits (Python's \d and float() accept them) and their
# ASCII values, generated from the Unicode database.
_UNICODE_DIGITS = "".join(
    ch for ch in map(chr, range(0x80, 0x10000)) if unicodedata.category(ch) == "Nd" and unicodedata.digit(ch, None) is not None
)
_ASCII_DIGITS = "".join(str(unicodedata.digit(ch)) for ch in _UNICODE_DIGITS)


def ascii_digits(c: Column) -> Column:
    """Map every Unicode decimal digit to its ASCII digit."""
    return F.translate(c, _UNICODE_DIGITS, _ASCII_DIGITS)


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (not just spaces);
    a character-set trim, no regex."""
    return F.btrim(c, F.lit(WHITESPACE))


def to_number(c: Column) -> Column:
    """Coerce text to double; anything that is not a number becomes null."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER_PATTERN), strip(text).try_cast("double"))


def parse_month(c: Column) -> Column:
    """Strict year-month text to the first day of that month.

    One-digit months are accepted. Malformed text fails the job (ANSI), as
    the strict parse it mirrors does; null stays null.
    """
    return F.to_date(strip(c.cast("string")), "yyyy-M")


def lease_years(c: Column) -> Column:
    """Remaining lease text ("61 years 04 months", "72 years", "5 months",
    "61.5") to years; unparseable or blank text gives null."""
    return lease_years_normalized(ascii_digits(F.lower(strip(c.cast("string")))))


def lease_years_normalized(text: Column) -> Column:
    """``lease_years`` of text already lower-cased and stripped."""
    # every pattern stands once where it is needed: Spark evaluates a repeated one
    # again in each branch, and most texts can be told to lack it without a pattern
    def number_before(unit: str) -> Column:
        found = F.regexp_extract(text, rf"(\d+){WS_CLASS}+{unit}", 1)
        return F.when(text.contains(unit), found).try_cast("double")  # not found: "", no double

    months = number_before("month") / 12.0
    joined = F.when(text.contains("_"), F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")).otherwise(text)
    return F.coalesce(number_before("year") + F.coalesce(months, F.lit(0.0)), months, to_number(joined))


def storey_midpoint(c: Column) -> Column:
    """Storey range text ("04 TO 06") to the midpoint of its first two numbers;
    one number gives itself, none gives null."""
    return storey_midpoint_normalized(ascii_digits(F.upper(strip(c.cast("string")))))


def storey_midpoint_normalized(text: Column) -> Column:
    """``storey_midpoint`` of text already upper-cased and stripped."""
    first = F.regexp_extract(text, r"(\d+)", 1).try_cast("double")
    second = F.regexp_extract(text, r"\d+\D+(\d+)", 1).try_cast("double")
    return F.coalesce((second + first) / 2.0, first)  # no number: "", which is null as a double


def year_fraction(month_start: Column) -> Column:
    """year + (month - 1) / 12 of a month-start date."""
    return F.year(month_start) + (F.month(month_start) - 1) / 12.0


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))
