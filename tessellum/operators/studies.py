"""Rooms and objects of a study's images, costs, reports, and files of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.text import half_up

#: Classes of a report, those of accelerated depreciation, and factors of quality.
REPORTED, ACCELERATED = ("5-year", "15-year", "27.5-year"), ("5-year", "15-year")
QUALITY = {"economy": 0.80, "standard": 1.00, "premium": 1.25, "luxury": 1.50}


def rooms(images: DataFrame) -> DataFrame:
    """A room for each image of a study (study_id, place, file_id, type, room_type, objects), numbered from 1 by place among the images; other files have none."""
    order = Window.partitionBy("study_id").orderBy("place")
    name = F.initcap(F.replace("room_type", F.lit("_"), F.lit(" ")))
    found = images.where(F.col("type").startswith("image/"))
    return found.select("*", F.concat(F.lit("room-"), F.row_number().over(order)).alias("room_id"), name.alias("name"))


def objects(images: DataFrame) -> DataFrame:
    """(study_id, object_id, label, room_id, file_id) of the objects that may be assets, numbered from 1 within a study by image and place."""
    each = rooms(images).select("study_id", "place", "room_id", "file_id", F.posexplode("objects").alias("at", "o")).where("o.potential_asset")
    number = F.row_number().over(Window.partitionBy("study_id").orderBy("place", "at"))
    return each.select("study_id", F.concat(F.lit("object-"), number).alias("object_id"), "o.label", "room_id", "file_id")


def final_cost(material: Column, labor: Column, equipment: Column, quantity: Column, location: Column, year: Column, quality: Column) -> Column:
    """Unit costs by quantity, location, year and quality; an unknown quality counts 1."""
    factor = F.coalesce(F.create_map(*[F.lit(x) for p in QUALITY.items() for x in p])[quality], F.lit(1.0))
    return (material + labor + equipment) * quantity * location * year * factor


def measure(kind: Column, count: Column, length: Column, width: Column) -> Column:
    """(quantity, unit): areas in SF, lengths in LF, perimeters in LF of both sides twice, other things by number in EA."""
    quantity = F.when(kind == "area", length * width).when(kind == "linear", length).when(kind == "perimeter", (length + width) * 2).otherwise(count)
    return F.struct(quantity.cast("double").alias("quantity"), F.when(kind == "area", "SF").when(kind.isin("linear", "perimeter"), "LF").otherwise("EA").alias("unit"))


def cost_totals(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Totals of estimates (by, estimate struct<final_cost, material, labor, equipment, quantity>, confidence); a null estimate adds no cost but counts, a null confidence is 0."""
    e = F.col("estimate")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    parts = [total(e[k] * e["quantity"]).alias(f"{k}_total") for k in ("material", "labor", "equipment")]
    return estimates.groupBy(*by).agg(total(e["final_cost"]).alias("total_cost"), *parts, F.count("*").alias("num_estimates"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"))


def report(assets: DataFrame, by: list[str]) -> DataFrame:
    """Number and value of each of three classes, the value of the accelerated ones and its percent of all assets' value, whole, 0 if there is none."""
    of = lambda c: F.col("category") == c
    value = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("value"))), F.lit(0))
    cells = [x for c in REPORTED for x in (F.count_if(F.coalesce(of(c), F.lit(False))).alias(f"n {c}"), value(of(c)).alias(f"value {c}"))]
    fast = value(F.col("category").isin(*ACCELERATED))
    whole = F.coalesce(F.sum("value"), F.lit(0))
    return assets.groupBy(*by).agg(*cells, fast.alias("accelerated"), F.when(whole > 0, half_up(fast / whole * 100)).otherwise(0.0).alias("percent"))


def evidence_rows(items: DataFrame, id_col: str, name_col: str, citations_col: str) -> DataFrame:
    """A row for each citation with its item and the item's name; items without citations have none."""
    return items.select(id_col, name_col, F.posexplode(citations_col).alias("place", "citation"))


def files_of(files: DataFrame, asset_id: object) -> DataFrame:
    """Files (asset_ids, ...) with associated, to the asset, and multi, to more than one."""
    associated = F.coalesce(F.array_contains("asset_ids", F.lit(asset_id)), F.lit(False))
    return files.withColumn("associated", associated).withColumn("multi", F.coalesce(F.size("asset_ids") > 1, F.lit(False)))


def searched(files: DataFrame, query: str) -> DataFrame:
    """Files whose name or type contains the query in any case; all for a blank one."""
    if not query.strip():
        return files
    return files.where(F.lower("name").contains(query.lower()) | F.lower("type").contains(query.lower()))


def overlaid(pristine: DataFrame, saved: DataFrame, local: DataFrame, id_col: str) -> DataFrame:
    """Pristine rows with the values of the local copy, else of the saved one; copies have one row an id and the same columns. Copies of other ids are left out."""
    others = [c for c in pristine.columns if c != id_col]
    copy = lambda df, name: df.select(id_col, F.struct(*others).alias(name))
    joined = pristine.select(id_col, F.struct(*others).alias("_pristine")).join(copy(saved, "_saved"), id_col, "left").join(copy(local, "_local"), id_col, "left")
    return joined.select(id_col, F.coalesce("_local", "_saved", "_pristine").alias("_row")).select(id_col, "_row.*")


def effective_quantity(manual: Column, detected: Column) -> Column:
    """(quantity, overridden): the manual quantity where there is one, else the detected one."""
    given = F.nullif(manual, F.lit(""))
    return F.struct(F.coalesce(given, detected).alias("quantity"), given.isNotNull().alias("overridden"))


def room_photos(rooms: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, misses) of rooms (room_id, photo_ids) and files (file_id, type): the images in order of ids, and the ids that are no image of the files."""
    asked = rooms.select("room_id", F.posexplode("photo_ids").alias("place", "file_id"))
    images = files.where(F.col("type").startswith("image/")).select("file_id").distinct()
    return asked.join(images, "file_id", "left_semi"), asked.join(images, "file_id", "left_anti")
