"""Tables as cells (table_id, row, col, content, confidence), rows and columns from 0, to fields of a form.

Null contents and tables without cells give no field; of repeated cells of one place the first content by text counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.functions import text
from tessellum.functions.typed import stripped

#: Kinds of table and the words one of which their cells contain, in this order.
KINDS = (("sales_comparison", ("comparable", "sale price")), ("cost_approach", ("cost new", "depreciation")), ("subject", ("property address", "borrower")))
#: Labels of cost cells and their fields, in this order; patterns of a subject table; confidence of a cell without any.
COSTS = (("site value", "site_value"), ("total cost new", "total_cost_new"))
SUBJECT = (
    ("property_address", r"Property Address\s+(.+?)\s+City"),
    ("city", r"City\s+(\w+)\s+State"),
    ("state", r"State\s+(\w{2})\s+Zip"),
    ("zip", r"Zip(?:\s+Code)?\s+(\d+)"),
    ("county", r"County\s+(\w+)"),
    ("borrower", r"Borrower\s+(.+?)\s+(?:Owner|County)"),
)
CELL_CONFIDENCE = 0.85
FIRST_COMPARABLE, LAST_COMPARABLE = 2, 4


def kinds(cells: DataFrame) -> DataFrame:
    """(table_id, kind) of the tables that are of one; words are looked for in each cell, so no table is gathered."""
    low = F.lower("content")
    seen = [F.bool_or(F.coalesce(low.rlike("|".join(words)), F.lit(False))).alias(kind) for kind, words in KINDS]
    kind = F.coalesce(*[F.when(F.col(k), k) for k, _ in KINDS])
    return cells.groupBy("table_id").agg(*seen).select("table_id", kind.alias("kind")).where("kind is not null")


def table_text(cells: DataFrame) -> DataFrame:
    """(table_id, text): the filled cells of each table, row by row, with a blank between."""
    found = F.array_sort(F.collect_list(F.struct("row", "col", "content")))
    whole = cells.where("coalesce(content, '') <> ''").groupBy("table_id").agg(found.alias("c"))
    return whole.select("table_id", F.array_join(F.transform("c", lambda x: x["content"]), " ").alias("text"))


def right_of(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels (cells) that have a cell to their right, with its content as `value`."""
    right = cells.groupBy("table_id", "row", (F.col("col") - 1).alias("col")).agg(F.min("content").alias("value"))
    return labels.join(right, ["table_id", "row", "col"])


def comparables(cells: DataFrame) -> DataFrame:
    """(table_id, place, name, value): columns 2 to 4 by the labels of column 0, places from 1 among those with a value.

    A name is the label in snake case, without other characters; of labels with one name the last row counts. A
    column beyond those of row 0 is none.
    """
    filled = cells.select("table_id", "row", "col", stripped(F.col("content")).alias("content")).where("content <> ''")
    name = F.regexp_replace(stripped(F.lower(F.regexp_replace("content", r"[^a-zA-Z0-9\s]", ""))), r"\s+", "_")
    labels = filled.where("col = 0").groupBy("table_id", "row").agg(F.min(name).alias("name"))
    width = cells.where("row = 0").groupBy("table_id").agg(F.max("col").alias("width"))
    values = filled.where(F.col("col").between(FIRST_COMPARABLE, LAST_COMPARABLE)).join(width, "table_id").where("col <= width")
    named = values.join(labels, ["table_id", "row"]).groupBy("table_id", "col", "name").agg(F.max_by("content", "row").alias("value"))
    there = named.groupBy("table_id").agg(F.array_sort(F.collect_set("col")).alias("there"))
    return named.join(there, "table_id").select("table_id", F.array_position("there", F.col("col")).cast("int").alias("place"), "name", "value")


def costs(cells: DataFrame) -> DataFrame:
    """(table_id, field, value, confidence): the amount right of a label cell; the last label of a field counts."""
    low = F.lower("content")
    field = F.coalesce(*[F.when(low.contains(words), f) for words, f in COSTS])
    found = right_of(cells, cells.withColumn("field", field).where("field is not null")).where("coalesce(value, '') <> ''")
    sure = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, CELL_CONFIDENCE).otherwise(F.col("confidence"))
    last = F.max_by(F.struct(text.currency(F.col("value")).cast("string").alias("value"), sure.alias("confidence")), F.struct("row", "col"))
    return found.groupBy("table_id", "field").agg(last.alias("v")).select("table_id", "field", "v.value", "v.confidence")


def subject(cells: DataFrame) -> DataFrame:
    """(table_id, field, value) of the patterns that match a table's text, in any case."""
    raw = [F.struct(F.lit(f).alias("field"), text.first_group(F.col("text"), p).alias("value")) for f, p in SUBJECT]
    rows = table_text(cells).select("table_id", F.inline(F.array(*raw))).where("value <> ''")
    return rows.withColumn("value", stripped(F.col("value")))


def table_fields(cells: DataFrame) -> DataFrame:
    """(table_id, section, field, value, confidence) of each table by its kind; comparables as JSON, names in order."""
    of = lambda kind: cells.join(kinds(cells).where(F.col("kind") == kind).select("table_id"), "table_id", "left_semi")
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    sales = comparables(of("sales_comparison")).groupBy("table_id", "place").agg(F.to_json(F.map_from_entries(pairs)).alias("value"))
    row = lambda df, section, field, sure: df.select("table_id", F.lit(section).alias("section"), field.alias("field"), "value", sure.alias("confidence"))
    fixed = F.lit(CELL_CONFIDENCE)
    return (
        row(sales, "sales_comparison", F.concat(F.lit("comparable_"), F.col("place")), fixed)
        .unionByName(row(costs(of("cost_approach")), "cost_approach", F.col("field"), F.col("confidence")))
        .unionByName(row(subject(of("subject")), "subject", F.col("field"), fixed))
    )
