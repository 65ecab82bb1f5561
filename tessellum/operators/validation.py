"""Rules over extracted fields: each is (rule, severity, condition under which it is a finding); a null condition is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Finding = tuple[str, str, Column]

#: The earliest year that is not odd, years ahead that are allowed, the largest amount that is not odd, and the share of a gap.
FIRST_YEAR, YEARS_AHEAD, LARGE_AMOUNT, GAP = 1800, 2, 100_000_000, 0.20


def year_rules(value: Column, this_year: Column) -> list[Finding]:
    """Four digits, not before FIRST_YEAR, and at most YEARS_AHEAD after this year. An empty value is no finding."""
    text = F.trim(value.cast("string"))
    year = F.when(text.rlike(r"^\d{4}$"), text).try_cast("int")
    return [
        ("year_format", "error", (text != "") & ~text.rlike(r"^\d{4}$")),
        ("year", "warning", year < FIRST_YEAR),
        ("year", "error", year > this_year + YEARS_AHEAD),
    ]


def amount_rules(name: str, cents: Column) -> list[Finding]:
    """A negative amount is an error, one above LARGE_AMOUNT a warning."""
    return [(name, "error", cents < 0), (name, "warning", cents > LARGE_AMOUNT * 100)]


def gap_rule(appraised: Column, contract: Column) -> Finding:
    """The appraised amount is more than GAP of the contract's away from it; none where the contract has none."""
    return ("gap", "warning", (contract > 0) & (F.abs(appraised - contract) > GAP * contract))


def presence_rules(fields: dict[str, tuple[Column, Column]], least: float = 0.90) -> list[Finding]:
    """Each critical field (value, confidence) is there, and its confidence is `least` or more."""
    out: list[Finding] = []
    for name, (value, confidence) in fields.items():
        there = F.coalesce(value.cast("string"), F.lit("")) != ""
        out += [(name, "error", ~there), (name, "warning", there & (F.coalesce(confidence, F.lit(0.0)) < least))]
    return out


def needs_review(findings: Column, critical: list[str]) -> Column:
    """Of an array of struct(rule, severity): any error, or a warning on a critical field."""
    return F.exists(findings, lambda f: (f["severity"] == "error") | f["rule"].isin(critical))
