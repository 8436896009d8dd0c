"""Text normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the normalisers see it: also NBSP and other separators.
SPACES = r"[\s \p{Z}]+"


def squish(x: Column) -> Column:
    """Trim and collapse white space. Null stays null."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def squish_for_matching(x: Column) -> Column:
    """Lower case, join words hyphenated over line breaks, squish."""
    return squish(F.regexp_replace(F.lower(x), r"(\w)-\s+(\w)", "$1$2"))


def normalize_name(x: Column) -> Column:
    """Lower, collapse, drop other than ``[a-z0-9 ]``, trim, in this order."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), "[^a-z0-9 ]", ""))


def normalize_name_for_grouping(x: Column) -> Column:
    """As P05 after deleting the words the/of/act/and; collapses last."""
    cut = F.regexp_replace(F.lower(x), r"\b(the|of|act|and)\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9 ]", ""), r"\s+", " "))


def year_in(x: Column) -> Column:
    """First four-digit year of 1900-2099 as int, else null."""
    return F.nullif(F.regexp_extract(x, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def strip_controls(x: Column) -> Column:
    """Drop control characters other than tab and newlines."""
    return F.regexp_replace(x, r"[\x01-\x08\x0b\x0c\x0e-\x1f]", "")


def approx_tokens(x: Column) -> Column:
    """A quarter of the length, rounded half to even."""
    return F.bround(F.length(x) / F.lit(4)).cast("int")


def truncate(x: Column, n: int = 48) -> Column:
    """At most ``n`` characters, the last of which is an ellipsis if cut."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)
