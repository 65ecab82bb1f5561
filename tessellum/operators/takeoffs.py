"""Filters, totals and shares of takeoffs, assets and studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.text import half_up


def filtered(rows: DataFrame, *, equal: dict[str, str | None], search: str | None, fields: list[str]) -> DataFrame:
    """Rows equal in the columns named, where the value is neither null nor `all`, and with the text searched for in their joined fields, in any case."""
    for column, value in equal.items():
        if value is not None and value != "all":
            rows = rows.where(F.col(column) == value)
    if search:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(search.lower())))
    return rows


def sort_keys(field: str, *, descending: bool = False, text: bool = False) -> list[Column]:
    """Orders nulls last in both directions, text without case."""
    key = F.lower(F.col(field)) if text else F.col(field)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last()]


def total_cost() -> Column:
    """U4: sum of (takeoff_cost, else unit_cost, else 0) times quantity, in whole cents."""
    cost = F.coalesce("takeoff_cost", "unit_cost", F.lit(0.0)) * F.coalesce("quantity", F.lit(0.0))
    return F.coalesce(F.sum(F.round(cost * 100).cast("long")), F.lit(0)).alias("total_cents")


def by_class(rows: DataFrame, column: str) -> DataFrame:
    """Count, total and percent of the total of each class; a null or empty class is unknown."""
    name = F.when(F.coalesce(F.col(column), F.lit("")) == "", "unknown").otherwise(F.col(column))
    each = rows.groupBy(name.alias("class")).agg(F.count("*").alias("n"), total_cost())
    total = each.agg(F.sum("total_cents").alias("all_cents"))
    share = F.when(F.col("all_cents") == 0, 0.0).otherwise(half_up(F.col("total_cents") * 100 / F.col("all_cents"), 2))
    return each.crossJoin(F.broadcast(total)).select("class", "n", "total_cents", share.alias("percent"))  # one row
