"""Text scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_tokens(text: Column) -> Column:
    """Alphanumeric runs that begin with a letter, two characters or more, lower-cased; null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"(?<![\p{L}\p{N}_])[a-z][a-z0-9]+(?![\p{L}\p{N}_])"), F.lit(0))


def blank_tokens(text: Column) -> Column:
    """Runs of characters other than blanks; the unit of chunk length."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def slug(name: Column, limit: int = 30) -> Column:
    """I16: other characters than letters and digits become _, outer ones go, cut to limit, upper case."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]", "_")
    return F.upper(F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, limit))


def snake(label: Column) -> Column:
    """Snake case of a label."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[^a-z0-9]+", "_")


def number(text: Column) -> Column:
    """Commas stripped, read as a double, 0 where that fails."""
    return F.coalesce(F.regexp_replace(text, ",", "").try_cast("double"), F.lit(0.0))


def currency(text: Column) -> Column:
    """Digits of an amount of money as a long, 0 where there is none."""
    return F.coalesce(F.regexp_replace(text, r"[$,\s]", "").try_cast("double").cast("long"), F.lit(0).cast("long"))


def first_group(text: Column, pattern: str) -> Column:
    """The first group of a case-insensitive pattern, '' where it does not match."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)(?d)" + pattern, 1)


def excerpt(text: Column, limit: int = 500) -> Column:
    """The first characters of a text."""
    return F.substring(text, 1, limit)


def prettify(label: Column) -> Column:
    """Snake or camel case to Title Case."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(label, "_", " "), "([a-z])([A-Z])", "$1 $2")))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(value * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)
