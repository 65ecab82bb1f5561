"""Answers of models in free text with JSON in it, to rows; a broken or null answer keeps its row with the values for none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named attributes of a component; others go to a map.
ATTRIBUTES = ("component_type", "material", "condition", "color", "brand", "model", "dimensions_note", "installation_type")
#: Of each kind of answer the keys that it must have, the key that finds it without a fence, and values for keys that it has not.
KINDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], dict[str, str | None]]] = {
    "takeoff": (("component_name", "quantity"), ("component_name", "quantity"), {"unit": "EA", "measurement_method": "count", "confidence": "0.5", "rsmeans_line_item": None}),
    "cost": (("component_name", "final_cost"), ("component_name", "final_cost"), {"quantity": "1", "unit": "EA", "material_cost_per_unit": "0", "labor_cost_per_unit": "0", "equipment_cost_per_unit": "0", "confidence": "0.5"}),
    "room": (("room_type", "irs_space_category"), ("room_type",), {"property_class": "commercial", "indoor_outdoor": "indoor", "default_recovery_period": "39", "asset_class_hint": None}),
    "object": (("component_name",), ("component_name",), {"component_category": "equipment", "attachment_type": "removable", "function_type": "utility", "likely_section": "unknown", "likely_recovery": None}),
    "asset": (("bucket", "section"), ("bucket",), {"life_years": None, "macrs_system": "GDS", "asset_class": None}),
}
#: Years of a bucket, whole; other buckets have OTHER_YEARS.
BUCKET_YEARS, OTHER_YEARS = {"5-year": 5, "7-year": 7, "15-year": 15, "27.5-year": 27, "39-year": 39}, 39


def json_body(answer: Column) -> Column:
    """The JSON of an answer: what its first fence holds, json ones first, else the widest braces; without a closing fence the last character goes."""
    text = F.trim(answer)

    def fenced(mark: str) -> Column:
        after = F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
        close = F.instr(after, "```")
        return F.when(F.instr(text, mark) > 0, F.trim(F.substring(after, F.lit(1), F.when(close > 0, close - 1).otherwise(F.length(after) - 1))))

    body = F.regexp_replace(F.coalesce(fenced("```json"), fenced("```"), text), r"^\s+|\s+$", "")
    wide = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(body.startswith("{") | (wide == ""), body).otherwise(wide)


def _parsed(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def components(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ATTRIBUTES, more): what an answer says of a component; `more` maps its other keys. Unknown type where it can't be read."""
    found = answers.select(F.col(id_col).alias("id"), _parsed(json_body(F.col(text_col))).alias("m"))
    kept = [F.col("m")[a].alias(a) for a in ATTRIBUTES[1:]]
    kind = F.when(F.col("m").isNull() | ~F.map_contains_key("m", ATTRIBUTES[0]), "unknown").otherwise(F.col("m")[ATTRIBUTES[0]])
    more = F.coalesce(F.map_filter("m", lambda k, v: ~k.isin(*ATTRIBUTES)), F.create_map().cast("map<string,string>"))
    return found.select("id", kind.alias(ATTRIBUTES[0]), *kept, more.alias("more"))


def first_object(text: Column, required: tuple[str, ...], shown: tuple[str, ...]) -> Column:
    """The first JSON object with the required keys, as a map: flat braces with the keys of shown, json fences, other fences; else null."""
    inner = "".join(rf'"{k}"[^{{}}]*' for k in shown)
    patterns = ((rf"(?s)\{{[^{{}}]*{inner}\}}", 0), (r"(?s)```json\s*(.*?)\s*```", 1), (r"(?s)```\s*(.*?)\s*```", 1))
    tries = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in patterns])
    maps = F.transform(F.filter(F.transform(tries, lambda t: F.trim(t)), lambda t: t.startswith("{")), _parsed)
    has = lambda m: F.coalesce(F.forall(F.array(*[F.lit(k) for k in required]), lambda k: F.map_contains_key(m, k)), F.lit(False))
    return F.get(F.filter(maps, has), F.lit(0))


def answered(answers: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(id, the required keys, the other keys of KINDS[kind] or their values for none, failed).

    Quantities and costs that are no numbers fail. Of an asset without such an object, bucket and section are looked
    for in the text.
    """
    required, shown, others = KINDS[kind]
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = answers.select(F.col(id_col).alias("id"), text.alias("t"), first_object(text, required, shown).alias("m"))
    numbers = [k for k in ("quantity", "final_cost") if k in required]
    if numbers:
        bad = F.lit(False)
        for k in numbers:
            bad = bad | F.col("m")[k].try_cast("double").isNull()
        found = found.withColumn("m", F.when(~bad, F.col("m")))
    value = {k: F.col("m")[k] for k in required}
    value |= {k: F.when(F.map_contains_key("m", k), F.col("m")[k]).otherwise(none) if none is not None else F.col("m")[k] for k, none in others.items()}
    if kind == "asset":
        value |= _asset(value["life_years"], value["macrs_system"])
    failed = value[required[0]].isNull() if kind == "asset" else F.col("m").isNull()
    return found.select("id", *[F.when(~failed, v).alias(k) for k, v in value.items()], failed.alias("failed"))


def _asset(life: Column, system: Column) -> dict[str, Column]:
    """Bucket, section and years of an asset's answer, from its object, else from its text if that names both."""
    bucket = F.replace(F.lower(F.col("m")["bucket"]), F.lit("_"), F.lit("-"))
    bucket = F.when(bucket.endswith("-year"), bucket).otherwise(F.concat(bucket, F.lit("-year")))
    years = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in (r"(?i)(\d+(?:\.\d+)?)[- ]?year", r"""(?i)bucket[:\s]+["']?(\d+)["']?""")])
    section = F.when(F.col("t").contains("1245"), "1245").when(F.col("t").contains("1250"), "1250")
    read = F.col("m").isNotNull()
    bucket = F.when(read, bucket).when(section.isNotNull(), F.concat(years, F.lit("-year")))
    section = F.when(read, F.col("m")["section"]).when(years.isNotNull(), section)
    known = F.coalesce(*[F.when(F.lower(bucket) == b, y) for b, y in BUCKET_YEARS.items()], F.lit(OTHER_YEARS)).cast("string")
    return {"bucket": bucket, "section": section, "life_years": F.coalesce(life, known), "macrs_system": F.coalesce(system, F.lit("GDS"))}


def masks(answers: DataFrame, id_col: str, json_col: str, height: int, width: int) -> DataFrame:
    """(id, kind, counts, height, width) of a mask's answer: a run-length mask, the first of its masks at the image's size, a URL without either, or none."""
    text = F.trim(F.col(json_col))
    own = F.from_json(text, "struct<counts string, size array<int>, masks array<struct<counts string>>>")
    rows = answers.select(F.col(id_col).alias("id"), text.alias("t"), own.alias("o"))
    direct = F.col("o.counts").isNotNull() & F.col("o.size").isNotNull()
    first = F.get("o.masks", F.lit(0))["counts"]
    kind = F.when(direct, "rle").when(first.isNotNull(), "first").when(F.col("t").startswith('"'), "url").otherwise("none")
    size = lambda i, n: F.when(direct, F.get("o.size", F.lit(i))).when(first.isNotNull(), n)
    return rows.select("id", kind.alias("kind"), F.when(direct, F.col("o.counts")).otherwise(first).alias("counts"), size(0, height).alias("height"), size(1, width).alias("width"))
