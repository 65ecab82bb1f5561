"""Typed fields of a report's text by patterns: each field is a rule, and all rules are columns of one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """The first pattern whose first group can be read as `kind`, and lies in `within`, gives the field."""

    field: str
    patterns: tuple[str, ...]
    kind: str = "text"
    within: tuple[float, float] | None = None
    any_case: bool = True


def _value(*words: str) -> tuple[str, ...]:
    return tuple(rf"{w}[:\s]+\$?([\d,]+(?:\.\d{{2}})?)" for w in words)


def _area(*words: str) -> tuple[str, ...]:
    return tuple(rf"{w}[:\s]+([\d,]+)\s*(?:sf|sq\.?\s*ft|square feet)?" for w in words)


def _age(word: str) -> tuple[str, ...]:
    return (rf"{word}[:\s]+(\d+)\s*(?:years?)?",)


def _factor(*words: str) -> tuple[str, ...]:
    return tuple(rf"{w}[:\s]+([\d.]+)" for w in words)


def _date(kind: str) -> tuple[str, ...]:
    return (rf"{kind}\s+date[:\s]+(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})", rf"{kind}\s+date[:\s]+(\w+\s+\d{{1,2}},?\s+\d{{4}})", r"(\d{1,2}/\d{1,2}/\d{2,4})")


#: Patterns, words and their order decide what is found.
_GRADES = "excellent|very good|good|average|fair|poor"
RULES: tuple[Rule, ...] = (
    Rule("property_address", (r"(?:property address|subject property|location)[:\s]+([^\n]{10,100})", r"(\d+\s+[\w\s]+(?:street|st|avenue|ave|road|rd|drive|dr|boulevard|blvd)[^\n]{0,50})")),
    Rule("appraisal_date", _date("appraisal")),
    Rule("effective_date", _date("effective")),
    Rule("total_value", _value("total value", "appraised value", "market value"), "double"),
    Rule("land_value", _value("land value", "site value"), "double"),
    Rule("building_value", _value("building value", "improvement value"), "double"),
    Rule("site_improvements_value", _value("site improvement", "land improvement"), "double"),
    Rule("construction_class", (r"(?:construction\s+)?class[:\s]+([A-DS])\b", r"class\s+([A-DS])\s+construction"), "upper"),
    Rule("quality_rating", (rf"quality[:\s]+({_GRADES})", rf"({_GRADES})\s+quality"), "title"),
    Rule("condition_rating", (rf"condition[:\s]+({_GRADES})", rf"({_GRADES})\s+condition"), "title"),
    Rule("gross_building_area_sf", _area("gross building area", "gba", "gross area"), "double"),
    Rule("net_leasable_area_sf", _area("net leasable", "nla", "rentable area"), "double"),
    Rule("land_area_sf", _area("land area", "site area", "lot size"), "double"),
    Rule("land_area_acres", (r"([\d.]+)\s*(?:acres?|ac)", r"land.*?([\d.]+)\s*(?:acres?|ac)"), "double"),
    Rule("num_floors", (r"(\d+)\s*(?:floor|stor(?:y|ies))", r"(?:floors?|stories?)[:\s]+(\d+)"), "bigint"),
    Rule("num_units", (r"(\d+)\s*(?:unit|apartment|suite)s?", r"(?:units?|apartments?)[:\s]+(\d+)"), "bigint"),
    Rule("year_built", (r"year\s+built[:\s]+(\d{4})", r"built\s+in\s+(\d{4})", r"constructed\s+(?:in\s+)?(\d{4})"), "bigint", (1800, 2030)),
    Rule("effective_age_years", _age("effective age"), "bigint"),
    Rule("remaining_economic_life_years", _age("remaining economic life"), "bigint"),
    Rule("total_economic_life_years", _age("total economic life"), "bigint"),
    Rule("city", (r"(?:city|location)[:\s]+(\w+(?:\s+\w+)?)", r"(\w+(?:\s+\w+)?),\s*[A-Z]{2}\s+\d{5}"), "title"),
    Rule("state", (r"\b([A-Z]{2})\s+\d{5}",), any_case=False),
    Rule("county", (r"(\w+)\s+county",), "title"),
    Rule("zip_code", (r"\b(\d{5}(?:-\d{4})?)\b",)),
    Rule("location_factor", _factor("location factor", "local multiplier"), "double", (0.5, 2.0)),
    Rule("current_cost_multiplier", _factor("current cost", "time multiplier"), "double", (0.5, 2.0)),
)
#: Fields that are the first of these that stands in the text.
LISTS: dict[str, tuple[str, ...]] = {
    "building_type": ("apartment", "office", "retail", "industrial", "warehouse", "residential", "multifamily", "single family", "commercial", "mixed use", "hotel", "motel", "restaurant", "medical", "hospital", "school", "church"),
    "property_use": ("residential rental", "commercial", "industrial", "retail", "office", "multifamily", "single family", "mixed use"),
}
#: Fields that count for coverage, which is their number over this total.
COUNTED = ("property_address", "appraisal_date", "total_value", "land_value", "building_value", "building_type", "property_use", "gross_building_area_sf", "land_area_sf", "year_built", "effective_age_years", "remaining_economic_life_years", "city", "state")
TOTAL = 25


def _only(value: Column, holds: Callable[[Column], Column]) -> Column:
    """value where holds(value), else null; value is computed once a row, as a lambda's variable is bound."""
    return F.get(F.filter(F.array(value), holds), F.lit(0))


def _read(rule: Rule, text: Column, pattern: str) -> Column:
    # (?d): only \n ends a line, as the patterns mean it
    found = _only(F.trim(F.regexp_extract(text, ("(?i)" if rule.any_case else "") + "(?d)" + pattern, 1)), lambda v: v != "")
    if rule.kind in ("double", "bigint"):
        found = F.replace(found, F.lit(","), F.lit("")).try_cast(rule.kind)
    elif rule.kind != "text":
        found = {"title": F.initcap, "upper": F.upper}[rule.kind](found)
    within = rule.within
    return _only(found, lambda v: v.between(*within)) if within else found


def report_fields(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, a column for each rule and list, coverage double): no shuffle, a null text has no fields."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = lambda words: F.coalesce(*[F.when(F.lower(text).contains(w), F.lit(w.title())) for w in words])
    ruled = [F.coalesce(*[_read(r, text, p) for p in r.patterns]).alias(r.field) for r in RULES]
    found = docs.select(F.col(id_col).alias("id"), *ruled, *[first(words).alias(field) for field, words in LISTS.items()])
    return found.withColumn("coverage", sum(F.col(c).isNotNull().cast("int") for c in COUNTED) / F.lit(float(TOTAL)))


def field_rows(fields: DataFrame, critical: list[str]) -> DataFrame:
    """(id, field, value string, confidence) of the fields with a value: 0.7 if critical, 0.8 if longer than five characters, else 0.75."""
    names = [c for c in fields.columns if c not in ("id", "coverage")]
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names])
    rows = fields.select("id", F.inline(each)).where("coalesce(value, '') <> ''")
    sure = F.when(F.col("field").isin(critical), 0.7).when(F.length("value") > 5, 0.8).otherwise(0.75)
    return rows.withColumn("confidence", sure)
