"""Queries over models' answers, artifacts and their detections, and captions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import answers, grounding, layout
from tessellum.plans import evidence

COMPONENTS = ["oven", "Cabinet", "faucet", "window pane", "rug"]
LABELS = ["stove", "kitchen cabinet", "sink", "door", "carpet"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], by: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({by} % {len(values)} as int) + 1"))


def _entries(of: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(of)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(of)


def component_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each event: in fences, bare, within a text, broken, none."""
    text = r"""CASE event_id % 6 WHEN 0 THEN concat('Seen:\n```json\n{"component_type": "', event_type, '", "material": "oak", "layers": 2, "finish": "matt"}\n```') WHEN 1 THEN concat(' {"component_type": "', event_type, '", "color": null} ')
WHEN 2 THEN 'It is {"material": "steel"} I think' WHEN 3 THEN 'nothing' WHEN 4 THEN concat('```\n{"component_type": "', event_type, '"}') END"""
    found = answers.components(_table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS answer"), "event_id", "answer")
    return found.select("id", "component_type", "material", "color", _entries("more"))


def agent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each event, read as each of five kinds."""
    text = r"""CASE event_id % 6 WHEN 0 THEN concat('Result {"component_name": "', event_type, '", "quantity": 3.5, "final_cost": 12, "room_type": "kitchen", "irs_space_category": "unit", "bucket": "5_YEAR", "section": "1245", "unit": "SF"} done')
WHEN 1 THEN concat('```json\n{"component_name": "', event_type, '", "tags": {"a": 1}, "quantity": "4", "final_cost": 1.5, "room_type": "hall", "irs_space_category": "common", "bucket": "15-year", "section": "1250", "life_years": 14}\n```')
WHEN 2 THEN 'It is 7-year property of section 1250' WHEN 3 THEN concat('{"component_name": "', event_type, '", "quantity": "many", "final_cost": "x"}') WHEN 4 THEN 'Bucket: 5 and 1245' END"""
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS answer")
    out = None
    for kind, shown in {"takeoff": ("component_name", "quantity", "unit"), "cost": ("component_name", "final_cost", "quantity"), "room": ("room_type", "irs_space_category", "property_class"), "object": ("component_name", "component_category", "likely_section"), "asset": ("bucket", "section", "life_years")}.items():
        found = answers.answered(rows, "event_id", "answer", kind).select("id", F.lit(kind).alias("kind"), *[F.col(c).alias(n) for c, n in zip(shown, "abc", strict=True)], "failed")
        out = found if out is None else out.unionByName(found)
    return out


def mask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    text = """CASE event_id % 5 WHEN 0 THEN concat('{"counts": "c', event_id, '", "size": [3, 4]}') WHEN 1 THEN concat('{"masks": [{"counts": "m', event_id, '"}, {"counts": "x"}]}') WHEN 2 THEN '"https://x/y"' WHEN 3 THEN '{"masks": []}' END"""
    return answers.masks(_table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS answer"), "event_id", "answer", 480, 640)


def _seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    boxes = evidence._boxes(spark, sf_dir)
    artifacts = boxes.where("id % 2 = 1").select("image_id", F.col("id").alias("artifact_id"), F.expr("if(id % 3 = 0, id - 1, -1)").alias("detection_id"), _pick(COMPONENTS, "id").alias("component"), "box")
    detections = boxes.where("id % 2 = 0").select("image_id", F.col("id").alias("place"), F.col("id").alias("detection_id"), _pick(LABELS, "floor(id / 2)").alias("label"), F.expr("id % 10 / 10").alias("confidence"), "box")
    return artifacts, detections


def artifact_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the artifacts name their detection."""
    return grounding.verified(*_seen(spark, sf_dir)).withColumn("iou", F.round("iou", 6)).withColumn("confidence", F.round("confidence", 6))


def region_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17."""
    return grounding.verified_region(*_seen(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


def built_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact of each event, every ninth with an error."""
    made = grounding.built(_pick(COMPONENTS, "event_id"), _pick(LABELS, "floor(event_id / 2)"), F.expr("event_id * 7919 % 1000 / 1000"), F.expr("if(event_id % 9 = 0, 'timeout', null)"))
    return _table(spark, sf_dir, "events").select("event_id", made.alias("a")).select("event_id", "a.*")


def corrected_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is an artifact, the events of two types are corrections."""
    events = _table(spark, sf_dir, "events")
    kinds = ["classification.material", "note", "classification.a.b", "classification.brand"]
    fixes = events.where("event_type in ('purchase', 'error')").select(F.col("user_id").alias("artifact_id"), F.col("event_id").alias("correction_id"), _pick(kinds, "event_id").alias("field"), F.col("event_type").alias("value"))
    artifacts = events.select(F.col("user_id").alias("artifact_id")).distinct().selectExpr("artifact_id", "map('material', 'oak', 'color', 'red') AS classification", "map('note', 'n') AS fields")
    return grounding.corrected(artifacts, fixes).select("artifact_id", _entries("classification"), _entries("fields"), "corrected", "correction_id")


def reviewed_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is an artifact, purchases and errors are decisions."""
    events = _table(spark, sf_dir, "events")
    decisions = events.where("event_type in ('purchase', 'error')").selectExpr("user_id AS artifact_id", "event_id AS seq", "event_type = 'purchase' AS approved", "concat('n', event_id) AS notes")
    return grounding.reviewed(events.select(F.col("user_id").alias("artifact_id")).distinct(), decisions)


def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts, reviewed ones, and approved and rejected ones of those."""
    return reviewed_artifacts(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("reviewed").alias("n_reviewed"), F.count_if(F.col("reviewed") & F.coalesce("approved", F.lit(True))).alias("n_approved"), F.count_if(F.col("reviewed") & ~F.coalesce("approved", F.lit(True))).alias("n_rejected"))


def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with a table, lines and elements for each order."""
    pages = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page", "CAST(200 + o_orderkey % 50 AS double) AS y")
    tables = pages.selectExpr("page", "1 AS table_id", "100D AS x0", "y AS y0", "300D AS x1", "y + 100 AS y1")
    text = "element_at(array('Table 3: Costs', ' TABLE A-1 - More', 'table 2. ', 'Costs Table 3: x'), CAST(page % 4 AS int) + 1)"
    line = "named_struct('x0', 90D, 'y0', y - {0}, 'x1', CAST({1} AS double), 'y1', y - {2}, 'text', {3})"
    rows = [line.format(30, "if(page % 7 = 0, 400, 280)", 10, text), line.format(80, "200", 60, "'Table 9: far'"), f"if(page % 5 = 0, {line.format(9, '200', 1, repr('second'))}, null)"]
    lines = pages.selectExpr("page", f"inline(filter(array({', '.join(rows)}), x -> x IS NOT NULL))")
    elements = pages.selectExpr("page", "posexplode(array(210D, if(page % 2 = 1, 249D, 251D), 100D)) AS (seq, y0)").withColumn("element_id", F.col("seq"))
    near = lines.withColumn("l", F.struct("x0", "y0", "x1", "y1")).select("page", "l").join(tables.select("page", F.struct("x0", "y0", "x1", "y1").alias("t")), "page")
    near = near.groupBy("page").agg(F.count_if(layout.overlapping(F.col("l"), F.col("t"))).alias("near"))
    found = layout.placed_tables(layout.captioned(tables, lines, ["page"]), elements, ["page"])
    return found.join(near, "page").select("page", "caption", "element_id", "near")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (component_answers, agent_answers, mask_answers, artifact_grounding, region_grounding, built_artifacts, corrected_artifacts, reviewed_artifacts, review_totals, table_captions)
}

_RELATED = "(component, label) IN (('oven', 'stove'), ('Cabinet', 'kitchen cabinet'), ('faucet', 'sink'))"
_SEEN = f"""{evidence._BOXES},
o AS (SELECT id, image_id, x0, y0, x1, y1, CASE WHEN id % 3 = 0 THEN id - 1 ELSE -1 END AS named, {COMPONENTS}[id % 5 + 1] AS component FROM x WHERE id % 2 = 1),
d AS (SELECT id, image_id, x0, y0, x1, y1, {LABELS}[id // 2 % 5 + 1] AS label, id % 10 / 10 AS confidence FROM x WHERE id % 2 = 0),
p AS (SELECT o.id AS artifact_id, o.component, d.id, d.label, d.confidence, greatest(0, least(o.x1, d.x1) - greatest(o.x0, d.x0)) * greatest(0, least(o.y1, d.y1) - greatest(o.y0, d.y0)) AS i, (o.x1 - o.x0) * (o.y1 - o.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) AS s FROM o JOIN d USING (image_id)),
r AS (SELECT *, i / (s - i) AS iou, row_number() OVER (PARTITION BY artifact_id ORDER BY i / (s - i) DESC, id) AS k FROM p WHERE i > 0),
b AS (SELECT o.image_id, o.id AS artifact_id, o.component, n.id AS n_id, n.label AS n_label, n.confidence AS n_confidence, r.id AS r_id, r.label AS r_label, r.confidence AS r_confidence, coalesce(r.iou, 0) AS iou
 FROM o LEFT JOIN r ON o.id = r.artifact_id AND k = 1 LEFT JOIN d n ON n.id = o.named AND n.image_id = o.image_id)"""
_CASES = """e AS (SELECT event_id, event_type AS t, event_id % 6 AS m FROM events)"""
_FIXES = """c AS (SELECT user_id, ['classification.material', 'note', 'classification.a.b', 'classification.brand'][event_id % 4 + 1] AS f, arg_max(event_type, event_id) AS v, max(event_id) AS i FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM events), w AS (SELECT u.user_id, max(v) FILTER (f LIKE '%material') AS m, max(v) FILTER (f LIKE '%brand') AS b, max(v) FILTER (f = 'note') AS n, max(v) FILTER (f LIKE '%a.b') AS ab, max(i) AS i FROM u LEFT JOIN c USING (user_id) GROUP BY ALL)"""
_REVIEWED = """SELECT user_id AS artifact_id, count(*) FILTER (d) > 0 AS reviewed, arg_max(event_type = 'purchase', event_id) FILTER (d) AS approved, 'n' || max(event_id) FILTER (d) AS notes FROM (SELECT *, event_type IN ('purchase', 'error') AS d FROM events) GROUP BY user_id"""
ORACLE_SQL: dict[str, str] = {
    "component_answers": f"WITH {_CASES} SELECT event_id AS id, CASE WHEN m < 2 THEN t ELSE 'unknown' END AS component_type, CASE m WHEN 0 THEN 'oak' WHEN 2 THEN 'steel' END AS material, CAST(NULL AS VARCHAR) AS color, CASE WHEN m = 0 THEN 'finish=matt,layers=2' ELSE '' END AS more FROM e",
    "agent_answers": f"""WITH {_CASES}
SELECT event_id AS id, 'takeoff' AS kind, CASE WHEN m < 2 THEN t END AS a, CASE m WHEN 0 THEN '3.5' WHEN 1 THEN '4' END AS b, CASE m WHEN 0 THEN 'SF' WHEN 1 THEN 'EA' END AS c, m > 1 AS failed FROM e
UNION ALL SELECT event_id, 'cost', CASE WHEN m < 2 THEN t END, CASE m WHEN 0 THEN '12' WHEN 1 THEN '1.5' END, CASE m WHEN 0 THEN '3.5' WHEN 1 THEN '4' END, m > 1 FROM e
UNION ALL SELECT event_id, 'room', CASE m WHEN 0 THEN 'kitchen' WHEN 1 THEN 'hall' END, CASE m WHEN 0 THEN 'unit' WHEN 1 THEN 'common' END, CASE WHEN m < 2 THEN 'commercial' END, m > 1 FROM e
UNION ALL SELECT event_id, 'object', CASE WHEN m IN (0, 1, 3) THEN t END, CASE WHEN m IN (0, 1, 3) THEN 'equipment' END, CASE WHEN m IN (0, 1, 3) THEN 'unknown' END, m NOT IN (0, 1, 3) FROM e
UNION ALL SELECT event_id, 'asset', CASE m WHEN 0 THEN '5-year' WHEN 1 THEN '15-year' WHEN 2 THEN '7-year' WHEN 4 THEN '5-year' END, CASE m WHEN 0 THEN '1245' WHEN 1 THEN '1250' WHEN 2 THEN '1250' WHEN 4 THEN '1245' END, CASE m WHEN 0 THEN '5' WHEN 1 THEN '14' WHEN 2 THEN '7' WHEN 4 THEN '5' END, m IN (3, 5) FROM e""",
    "mask_answers": """SELECT event_id AS id, ['rle', 'first', 'url', 'none', 'none'][event_id % 5 + 1] AS kind, CASE event_id % 5 WHEN 0 THEN 'c' || event_id WHEN 1 THEN 'm' || event_id END AS counts, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 480 END AS height, CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 640 END AS width FROM events""",
    "artifact_grounding": f"""WITH {_SEEN}, v AS (SELECT *, coalesce(n_id, r_id) AS detection_id, coalesce(n_label, r_label) AS label, CASE WHEN n_id IS NULL THEN iou ELSE 1 END AS io, CASE WHEN n_id IS NULL THEN r_confidence * iou ELSE n_confidence END AS sure FROM b)
SELECT image_id, artifact_id, detection_id, label AS detection_label, round(io, 6) AS iou, coalesce(io >= 0.5 AND {_RELATED}, false) AS grounded, round(coalesce(CASE WHEN {_RELATED} THEN sure ELSE sure * 0.5 END, 0), 6) AS confidence FROM v""",
    "region_grounding": f"""WITH {_SEEN}, v AS (SELECT *, r_label AS label FROM b), g AS (SELECT *, coalesce(iou >= 0.5 AND {_RELATED}, false) AS grounded FROM v)
SELECT image_id, artifact_id, r_id AS detection_id, round(iou, 6) AS iou, grounded, CASE WHEN grounded THEN r_confidence ELSE 0 END AS confidence FROM g""",
    "built_artifacts": f"""WITH e AS (SELECT event_id, {COMPONENTS}[event_id % 5 + 1] AS component, {LABELS}[event_id // 2 % 5 + 1] AS label, event_id * 7919 % 1000 / 1000 AS c, event_id % 9 = 0 AS bad FROM events),
s AS (SELECT *, (component, label) IN (('oven', 'stove'), ('Cabinet', 'kitchen cabinet')) AS same FROM e)
SELECT event_id, CASE WHEN bad THEN label ELSE component END AS component, CASE WHEN bad THEN c * 0.5 ELSE c END AS confidence, bad OR same AS grounded, bad OR c < 0.5 OR NOT same AS needs_review,
CASE WHEN bad THEN 'VLM classification failed: timeout' WHEN c < 0.5 THEN 'Low confidence: ' || printf('%.2f', c) WHEN NOT same THEN 'VLM type ''' || component || ''' not grounded in detection ''' || label || '''' END AS reason FROM s""",
    "corrected_artifacts": f"""WITH {_FIXES} SELECT user_id AS artifact_id, CASE WHEN b IS NULL THEN '' ELSE 'brand=' || b || ',' END || 'color=red,material=' || coalesce(m, 'oak') AS classification,
CASE WHEN ab IS NULL THEN '' ELSE 'classification.a.b=' || ab || ',' END || 'note=' || coalesce(n, 'n') AS fields, i IS NOT NULL AS corrected, i AS correction_id FROM w""",
    "reviewed_artifacts": _REVIEWED,
    "review_totals": f"SELECT count(*) AS n, count(*) FILTER (reviewed) AS n_reviewed, count(*) FILTER (reviewed AND approved) AS n_approved, count(*) FILTER (reviewed AND NOT approved) AS n_rejected FROM ({_REVIEWED})",
    "table_captions": """SELECT o_orderkey AS page, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 20 = 10 THEN 'table 2. ' || chr(10) || 'second' WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'Table 3: Costs' WHEN 1 THEN 'TABLE A-1 - More' END END AS caption, CAST(o_orderkey % 2 AS INT) AS element_id, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS near FROM orders""",
}
