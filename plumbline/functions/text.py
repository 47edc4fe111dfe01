"""Text predicates and code lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed


def whole(pattern: str) -> str:
    """Anchor a pattern to the whole text."""
    return rf"\A{pattern}\z" if "|" not in pattern else rf"\A(?:{pattern})\z"


def matches(text: Column, *patterns: str) -> Column:
    """True when the text matches any of the patterns."""
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


# To find a pattern anywhere in a text, a leading or trailing part that may match a
# single character (or nothing) need not match more. These find the same texts as
# the full patterns without trying every start of every run of letters or digits.
_OCTET = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
FINDERS = {
    fixed.EMAIL: r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2}",
    fixed.US_PHONE: r"[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}",
    fixed.US_ZIPCODE: r"[0-9]{5}",
    fixed.IP4: rf"[0-9]\.{_OCTET}\.{_OCTET}\.[0-9]",
    fixed.IP6_FULL: r"[0-9a-fA-F]:([0-9a-fA-F]{1,4}:){6}[0-9a-fA-F]",
}


def contains_pattern(text: Column, pattern: str) -> Column:
    """True when the pattern occurs in the text; texts without its fixed character are not searched."""
    found = text.rlike(FINDERS.get(pattern, pattern))
    if pattern == fixed.EMAIL:
        return text.contains("@") & found
    if pattern == fixed.IP6_FULL:
        return text.contains(":") & found
    return found


def misses_format(text: Column, pattern: str) -> Column:
    """True for a non-empty text that does not have the format."""
    return (text != "") & ~text.rlike(whole(pattern))


def has_outer_whitespace(text: Column) -> Column:
    return matches(
        text, fixed.SURROUNDED_BOTH, fixed.SURROUNDED_BEFORE, fixed.SURROUNDED_AFTER
    )


def is_placeholder(text: Column) -> Column:
    return F.upper(text).isin(*fixed.NULL_PLACEHOLDERS)


def words(text: Column) -> Column:
    """Number of blank-separated words; NULL for an empty text."""
    return F.when(F.length(text) > 0, F.size(F.split(text, r"\s+", -1)))


def escape_pattern(text: Column) -> Column:
    """Put a backslash before every character with a meaning in a pattern."""
    return F.regexp_replace(text, r"([\\^$.*+?()\[\]{}|\-&~#\s])", r"\\$1")


def is_code(column: str, codes: list[str]) -> Column:
    """True when a column's upper-cased text is in a code list; one expression, however long the list."""
    quoted = ", ".join("'" + c.replace("'", "\\'") + "'" for c in codes)
    return F.expr(f"upper(CAST(`{column}` AS STRING)) IN ({quoted})")


def country_codes(spark: SparkSession) -> list[str]:
    """ISO 3166-1 alpha-2 codes, as the Java runtime lists them."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())


def code_lists(spark: SparkSession) -> dict[str, list[str]]:
    """Code lists a text column may be recognised as."""
    return {"ISO_3166_alpha2": country_codes(spark), "ISO_4217": list(fixed.CURRENCY_CODES)}
