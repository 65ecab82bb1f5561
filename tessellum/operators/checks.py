"""Answers of detectors and models to rows, keys to fields, and checks of rows and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.labels import relative_box
from tessellum.functions.text import half_up

#: Substrings of a key and the field they name, tried in this order.
KEY_PARTS = (
    ("address", "subject.property_address"), ("property addr", "subject.property_address"),
    ("sale price", "listing_and_contract.contract_price"), ("purchase price", "listing_and_contract.contract_price"),
    ("yr built", "improvements.year_built"), ("year", "improvements.year_built"),
    ("gla", "improvements.gross_living_area"), ("living area", "improvements.gross_living_area"), ("sq ft", "improvements.gross_living_area"),
    ("market value", "reconciliation.final_opinion_of_market_value"), ("appraised value", "reconciliation.final_opinion_of_market_value"),
)
#: Years of a class, other classes have OTHER_YEARS; classes an asset may have; sections to check.
YEARS, OTHER_YEARS = {"5-year": 5, "7-year": 7, "15-year": 15, "27.5-year": 27, "39-year": 39}, 39
CATEGORIES = ("5-year", "15-year", "27.5-year")
CHECKLIST = ("subject", "neighborhood", "site", "improvements", "sales_comparison", "cost_approach", "photos_sketch", "overall")
_DETECTION = "struct<label string, class string, confidence double, score double, box array<double>, bbox array<double>, x_min double, y_min double, x_max double, y_max double>"


def detections(answers: DataFrame, id_col: str, json_col: str, prompts: list[str]) -> DataFrame:
    """(id, place, label, confidence, box, prompt) of a detector's answers, an array or an object with `detections`.

    A box is `box`, `bbox` or four numbers, in pixels or parts; the prompt is the first that contains the label or is
    contained, else the first. Rows with a broken box, malformed answers and nulls give no row; place counts from 0 before that.
    """
    raw = F.coalesce(F.from_json(json_col, f"struct<detections array<{_DETECTION}>>")["detections"], F.from_json(json_col, f"array<{_DETECTION}>"))
    rows = answers.select(F.col(id_col).alias("id"), F.posexplode(raw).alias("place", "d"))
    loose = F.array(*[F.coalesce(F.col("d")[k], F.lit(v)) for k, v in (("x_min", 0.0), ("y_min", 0.0), ("x_max", 1.0), ("y_max", 1.0))])
    rows = rows.where("d is not null").select("id", "place", "d", F.coalesce("d.box", "d.bbox", loose).alias("b"))
    rows = rows.where((F.size("b") >= 4) & ~F.exists(F.slice("b", 1, 4), lambda v: v.isNull()))
    label = F.coalesce("d.label", "d.class", F.lit("unknown"))
    low = F.lower(label)
    fits = [F.when(low.contains(p.lower()) | F.lit(p.lower()).contains(low), p) for p in prompts]
    prompt = F.coalesce(*fits, F.lit(prompts[0])) if prompts else F.lit(None).cast("string")
    b = F.col("b")
    return rows.select("id", "place", label.alias("label"), F.coalesce("d.confidence", "d.score", F.lit(0.0)).alias("confidence"), relative_box(b[0], b[1], b[2], b[3]).alias("box"), prompt.alias("prompt"))


def answered_fields(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, value, confidence) of a model's answer, JSON bare or in a fence: {key: {value, confidence}}.

    Confidence is kept in [0, 1] and 0.7 if there is none; empty values, keys without an object and malformed answers give no row.
    """
    fenced = F.regexp_extract(text_col, r"(?s)```json\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.trim(F.col(text_col)))
    rows = answers.select(F.col(id_col).alias("id"), F.explode(F.from_json(body, "map<string,string>")).alias("key", "v")).where("v like '{%'")
    sure = F.coalesce(F.get_json_object("v", "$.confidence").try_cast("double"), F.lit(0.7))
    found = rows.select("id", "key", F.get_json_object("v", "$.value").alias("value"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)).alias("confidence"))
    return found.where("coalesce(value, '') <> ''")


def field_of_key(key: Column, exact: dict[str, str]) -> Column:
    """The field of a key: an exact name in any case, else the first of KEY_PARTS it contains, else null."""
    low = F.trim(F.lower(key))
    return F.coalesce(*[F.when(low == k.lower(), f) for k, f in exact.items()], *[F.when(low.contains(k), f) for k, f in KEY_PARTS])


def keyed_fields(pairs: DataFrame, exact: dict[str, str]) -> DataFrame:
    """(doc_id, field, value) from pairs (doc_id, seq, key, value): the last pair of a field wins."""
    known = pairs.withColumn("field", field_of_key(F.col("key"), exact)).where("field is not null")
    return known.groupBy("doc_id", "field").agg(F.max_by("value", "seq").alias("value"))


def area_warnings(area: Column, basement: Column) -> Column:
    """An array of what is odd about areas; nothing is if the living area is null."""
    odd = F.array(F.when(area < 100, "small").when(area > 50000, "large"), F.when(basement > area * 1.5, "basement"))
    return F.filter(odd, lambda w: w.isNotNull())


def _first_fault(*rules: tuple[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), field) for field, broken in rules])


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def takeoff_fault() -> Column:
    """The first field that makes a takeoff (id, description, quantity) invalid, null if none."""
    return _first_fault(("id", _blank("id")), ("description", _blank("description")), ("quantity", F.col("quantity").isNull() | (F.col("quantity") < 0)))


def asset_fault() -> Column:
    """The first field that makes an asset invalid, null if none; a null number is not checked."""
    share = F.col("percentage")
    category = ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    return _first_fault(("id", _blank("id")), ("name", _blank("name")), ("description", _blank("description")), ("category", category), ("value", F.col("value") < 0), ("period", F.col("period") <= 0), ("percentage", (share < 0) | (share > 100)))


def class_years(bucket: Column) -> Column:
    """Years of a class."""
    known = F.create_map(*[F.lit(x) for pair in YEARS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(bucket)), F.lit(OTHER_YEARS))


def checklist(saved: Column) -> Column:
    """(verified, percent, overall) of a saved map section -> boolean over the default sections.

    Missing sections are not verified; overall is, too, once all others are.
    """
    on = lambda s: F.coalesce(F.try_element_at(saved, F.lit(s)), F.lit(False))
    others = [on(s) for s in CHECKLIST if s != "overall"]
    done = sum(o.cast("int") for o in others)
    overall = on("overall") | (done == len(others))
    verified = done + overall.cast("int")
    return F.struct(verified.alias("verified"), half_up(verified * 100.0 / len(CHECKLIST)).alias("percent"), overall.alias("overall"))


def next_unverified(assets: DataFrame) -> DataFrame:
    """(study_id, id, next_id): after each unverified asset (study_id, id, seq, verified) the next one, the first after the last."""
    study = Window.partitionBy("study_id").orderBy("seq")
    waiting = assets.where("not coalesce(verified, false)")
    return waiting.select("study_id", "id", F.coalesce(F.lead("id").over(study), F.first("id").over(study)).alias("next_id"))


def progress(assets: DataFrame) -> DataFrame:
    """(study_id, n, verified, percent), halves towards plus infinity."""
    sums = assets.groupBy("study_id").agg(F.count("*").alias("n"), F.count_if(F.col("verified")).alias("verified"))
    return sums.withColumn("percent", half_up(F.col("verified") * 100.0 / F.col("n")))
