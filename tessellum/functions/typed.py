"""Values of fields in their type, as text: whole numbers without a point, other texts as they are; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that hold amounts and numbers, by the source that they are read from.
SERVICE_AMOUNTS = ("contract_price", "appraised_value", "site_value", "total_cost_new", "real_estate_taxes", "offering_price", "prior_sale_price", "seller_concessions")
SERVICE_NUMBERS = ("gross_living_area", "basement_area_sqft", "area_sqft", "days_on_market", "year_built", "tax_year")
XML_NUMBERS = ("contract_price", "appraised_value", "site_value", "total_cost_new", "depreciation_total", "real_estate_taxes", "gross_living_area", "basement_area_sqft", "area_sqft")
XML_WHOLE = ("year_built", "tax_year", "days_on_market", "rooms_above_grade", "bedrooms_above_grade", "general_description_stories")
XML_PARTS = ("bathrooms_above_grade",)
VISION_AMOUNTS = ("contract_price", "appraised_value", "site_value", "total_cost_new", "real_estate_taxes", "offering_price", "final_opinion_of_market_value")
VISION_NUMBERS = ("year_built", "tax_year", "days_on_market", "gross_living_area", "basement_area_sqft")

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _decimal(text: Column) -> Column:
    """The text as a double where it spells one, else null."""
    return F.when(text.rlike(_DECIMAL), text).try_cast("double")


def _whole(text: Column) -> Column:
    """The whole part of a decimal as text, else null."""
    return _decimal(text).cast("long").cast("string")


def service_value(field: Column, value: Column) -> Column:
    """Amounts without signs, 0 where they can't be read; numbers by their digits, the text where they can't."""
    text = stripped(value)
    amount = F.coalesce(_whole(F.regexp_replace(text, r"[$,\s]", "")), F.lit("0"))
    count = F.coalesce(_whole(F.regexp_replace(text, r"[^\d.]", "")), text)
    return F.when(value == "", value).when(field.isin(*SERVICE_AMOUNTS), amount).when(field.isin(*SERVICE_NUMBERS), count).otherwise(text)


def xml_value(field: Column, value: Column) -> Column:
    """Numbers whole or, with a point, as doubles; whole numbers; doubles; the text where it can't be read."""
    text = stripped(value)
    bare = stripped(F.regexp_replace(text, "[$,]", ""))
    whole = lambda t: F.when(t.rlike(r"^[+-]?\d+$"), t).try_cast("long").cast("string")
    number = F.coalesce(F.when(bare.contains("."), _decimal(bare).cast("string")).otherwise(whole(bare)), text)
    return (
        F.when(field.isin(*XML_NUMBERS), number)
        .when(field.isin(*XML_WHOLE), F.coalesce(whole(text), text))
        .when(field.isin(*XML_PARTS), F.coalesce(_decimal(text).cast("string"), text))
        .otherwise(text)
    )


def vision_value(key: Column, value: Column) -> Column:
    """As service_value, but for the last part of a dotted key, and the text as it was where it can't be read."""
    field = F.substring_index(key, ".", -1)
    amount = F.coalesce(_whole(F.regexp_replace(value, r"[$,\s]", "")), value)
    count = F.coalesce(_whole(F.regexp_replace(value, r"[^\d.]", "")), value)
    return F.when(field.isin(*VISION_AMOUNTS), amount).when(field.isin(*VISION_NUMBERS), count).otherwise(value)
