"""Queries over studies: rooms, stages, costs, reports, files, and chunks with their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import text, workflow
from tessellum.operators import layout, search, studies

ROOMS = ["living_room", "bath", "unknown", "front_porch", "hall"]
STATUSES = ["uploading_documents", "takeoffs_pending", "resource_extraction", "reviewing_rooms", "engineering_takeoff", "completed", "odd", "analyzing_rooms"]
CLASSES = ["5-year", "15-year", "27.5-year", "39-year"]
TIERS = ["economy", "standard", "premium", "luxury", "other"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], by: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast(pmod({by}, {len(values)}) as int) + 1"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of customers' studies, two in three of them images with three objects."""
    things = "array(" + ", ".join(f"named_struct('label', '{x}', 'potential_asset', (o_orderkey + {i}) % 2 = 0)" for i, x in enumerate(("sink", "lamp", "rug"))) + ")"
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("study_id"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").alias("file_id"),
        _pick(["image/png", "application/pdf", "image/jpeg"], "o_orderkey").alias("type"), _pick(ROOMS, "o_orderkey").alias("room_type"), F.expr(things).alias("objects"),
    )


def image_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    return studies.rooms(_images(spark, sf_dir)).select("study_id", "room_id", "name", "file_id")


def image_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    return studies.objects(_images(spark, sf_dir))


def stage_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event moves a study from one status towards another."""
    rows = _table(spark, sf_dir, "events").select("event_id", _pick(STATUSES, "event_id").alias("s"), _pick(STATUSES, "floor(event_id / 8)").alias("t"))
    s, t = F.col("s"), F.col("t")
    now = workflow.moved(s, F.lit(None).cast("string"), F.array(s, F.lit("reviewing_rooms")), t)
    found = rows.select("event_id", workflow.label(s).alias("label"), workflow.step(s).alias("step"), workflow.reachable(workflow.migrated(t), F.array(s), workflow.migrated(s)).alias("reachable"), workflow.valid_move(s, t).alias("valid"), now.alias("n"))
    return found.select("event_id", "label", "step", "reachable", "valid", "n.status", "n.current", "n.overall", F.size("n.visited").alias("n_visited"))


def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as estimates, every fifth part without one."""
    kind = _pick(["area", "linear", "perimeter", "count"], "l_linenumber")
    q = studies.measure(kind, F.lit(3), F.col("l_quantity").cast("long"), F.lit(2))["quantity"]
    unit = [F.col("l_linenumber").cast("double"), F.lit(2.0), F.expr("cast(l_partkey % 3 as double)")]
    final = studies.final_cost(*unit, q, F.lit(1.5), F.lit(2.0), _pick(TIERS, "l_partkey"))
    estimate = F.when(F.col("l_partkey") % 5 != 0, F.struct(final.alias("final_cost"), *[c.alias(n) for c, n in zip(unit, ("material", "labor", "equipment"), strict=True)], q.alias("quantity")))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", estimate.alias("estimate"), F.expr("if(l_linenumber % 3 = 0, null, l_linenumber / 8)").alias("confidence"))
    totals = studies.cost_totals(rows, ["l_orderkey"])
    return totals.select("l_orderkey", F.round("total_cost", 4).alias("total_cost"), "material_total", "labor_total", "equipment_total", "num_estimates", F.round("avg_confidence", 6).alias("avg_confidence"))


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as assets of four classes."""
    assets = _table(spark, sf_dir, "lineitem").select("l_orderkey", _pick(CLASSES, "l_partkey").alias("category"), F.col("l_quantity").cast("long").alias("value"))
    return studies.report(assets, ["l_orderkey"])


def asset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of assets, those with all in their name or type."""
    files = _table(spark, sf_dir, "part").selectExpr("p_partkey AS file_id", "p_name AS name", "p_type AS type", "CASE p_partkey % 4 WHEN 0 THEN array(1L) WHEN 1 THEN array(1L, p_partkey) WHEN 2 THEN array(2L) END AS asset_ids")
    return studies.files_of(studies.searched(files, "aLL"), 1).select("file_id", "associated", "multi")


def overlaid_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part is saved with another size, every fifth changed after that."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.lit("").alias("manual"))
    copy = lambda m, size, manual: parts.where(f"p_partkey % {m} = 0").select("p_partkey", F.lit(size).alias("size"), F.lit(manual).alias("manual"))
    found = studies.overlaid(parts, copy(3, "saved", ""), copy(5, "local", "7"), "p_partkey")
    return found.select("p_partkey", studies.effective_quantity(F.col("manual"), F.col("size")).alias("q")).select("p_partkey", "q.*")


def photo_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a room whose photos are three numbers; orders are files."""
    asked = _table(spark, sf_dir, "part").selectExpr("p_partkey AS room_id", "array(p_partkey * 2, p_partkey + 1, -p_partkey) AS photo_ids")
    found, missed = studies.room_photos(asked, _images(spark, sf_dir).select("file_id", "type"))
    return found.withColumn("found", F.lit(True)).unionByName(missed.withColumn("found", F.lit(False)))


def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of customers, every third of a table."""
    chunks = _table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS chunk_id", "o_orderkey % 4 AS start")
    return layout.interleaved(chunks.where("chunk_id % 3 <> 0"), chunks.where("chunk_id % 3 = 0"))


def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as chunks, every second of a nation's table."""
    chunks = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS chunk_id", "1 AS doc_id", "if(s_suppkey % 2 = 0, 'table_summary', 'text') AS chunk_type", "if(s_suppkey % 3 <> 0, s_nationkey, null) AS table_id")
    tables = _table(spark, sf_dir, "nation").selectExpr("n_nationkey AS table_id", "1 AS doc_id", "array('Nation', 'Region') AS headers", "array(array(n_name, cast(n_regionkey as string))) AS rows").where("table_id % 5 <> 0")
    return search.with_tables(chunks, tables).select("chunk_id", search.is_table_hit().alias("is_table"), "markdown")


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over parts' names and sizes."""
    name, size = F.col("p_name"), F.concat(F.lit("$1,"), F.col("p_size").cast("string"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", text.first_group(name, r"(\w+)$").alias("last_word"), text.number(F.concat(F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"))).alias("number"),
        text.snake(F.concat(name, F.lit(" (A)"))).alias("snake"), text.currency(F.when(F.col("p_partkey") % 3 != 0, size).otherwise("n/a")).alias("money"), text.excerpt(name, 7).alias("excerpt"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (image_rooms, image_objects, stage_moves, cost_totals, class_report, asset_files, overlaid_assets, photo_misses, chunk_order, chunk_tables, text_scalars)
}

_ROOMS = f"""f AS (SELECT o_custkey AS study_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, ['Living Room', 'Bath', 'Unknown', 'Front Porch', 'Hall'][o_orderkey % 5 + 1] AS name FROM orders WHERE o_orderkey % 3 <> 1)"""
_STAGES = ", ".join(f"('{s}', '{label}', {i})" for i, (s, label) in enumerate(workflow.STAGES.items()))
ORACLE_SQL: dict[str, str] = {
    "image_rooms": f"WITH {_ROOMS} SELECT study_id, 'room-' || n AS room_id, name, k AS file_id FROM f",
    "image_objects": f"""WITH {_ROOMS}, o AS (SELECT *, unnest(['sink', 'lamp', 'rug']) AS label, unnest(range(3)) AS i FROM f)
SELECT study_id, 'object-' || row_number() OVER (PARTITION BY study_id ORDER BY k, i) AS object_id, label, 'room-' || n AS room_id, k AS file_id FROM o WHERE (k + i) % 2 = 0""",
    "stage_moves": f"""WITH g(name, label, i) AS (VALUES {_STAGES}), e AS (SELECT event_id, {STATUSES}[event_id % 8 + 1] AS s, {STATUSES}[event_id // 8 % 8 + 1] AS t FROM events),
m AS (SELECT *, CASE s WHEN 'takeoffs_pending' THEN 'engineering_takeoff' ELSE s END AS ms, CASE t WHEN 'takeoffs_pending' THEN 'engineering_takeoff' ELSE t END AS mt FROM e),
j AS (SELECT m.*, coalesce(a.label, s) AS label, coalesce(a.i, -1) AS ia, coalesce(b.i, -1) AS ib, coalesce(c.i, -1) AS ic, coalesce(d.i, -1) AS id FROM m LEFT JOIN g a ON a.name = ms LEFT JOIN g b ON b.name = mt LEFT JOIN g c ON c.name = s LEFT JOIN g d ON d.name = t),
n AS (SELECT *, CASE WHEN id > ic THEN t ELSE s END AS status FROM j)
SELECT event_id, label, CAST(ia AS INT) AS step, s = mt OR (ib >= 0 AND ib = ia + 1) AS reachable, ic >= 0 AND id = ic + 1 AS valid, status, t AS current,
CASE status WHEN 'completed' THEN 'completed' WHEN 'uploading_documents' THEN 'pending' ELSE 'in_progress' END AS overall, CASE WHEN t IN (s, 'reviewing_rooms') THEN 2 ELSE 3 END AS n_visited FROM n""",
    "cost_totals": f"""WITH l AS (SELECT l_orderkey, l_linenumber AS m, l_partkey % 3 AS e, l_partkey % 5 <> 0 AS there, CAST(l_quantity AS BIGINT) AS n, [0.8, 1.0, 1.25, 1.5, 1.0][l_partkey % 5 + 1] AS f FROM lineitem),
q AS (SELECT *, CAST(CASE m % 4 WHEN 0 THEN n * 2 WHEN 1 THEN n WHEN 2 THEN (n + 2) * 2 ELSE 3 END AS DOUBLE) AS q FROM l)
SELECT l_orderkey, round(coalesce(sum((m + 2 + e) * q * 3 * f) FILTER (there), 0), 4) AS total_cost, coalesce(sum(m * q) FILTER (there), 0) AS material_total, coalesce(sum(2 * q) FILTER (there), 0) AS labor_total, coalesce(sum(e * q) FILTER (there), 0) AS equipment_total,
count(*) AS num_estimates, round(avg(CASE WHEN m % 3 = 0 THEN 0 ELSE m / 8 END), 6) AS avg_confidence FROM q GROUP BY l_orderkey""",
    "class_report": f"""WITH l AS (SELECT l_orderkey, l_partkey % 4 AS c, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
SELECT l_orderkey, count(*) FILTER (c = 0) AS "n 5-year", CAST(coalesce(sum(v) FILTER (c = 0), 0) AS BIGINT) AS "value 5-year", count(*) FILTER (c = 1) AS "n 15-year", CAST(coalesce(sum(v) FILTER (c = 1), 0) AS BIGINT) AS "value 15-year",
count(*) FILTER (c = 2) AS "n 27.5-year", CAST(coalesce(sum(v) FILTER (c = 2), 0) AS BIGINT) AS "value 27.5-year", CAST(coalesce(sum(v) FILTER (c < 2), 0) AS BIGINT) AS accelerated,
CASE WHEN sum(v) > 0 THEN floor(coalesce(sum(v) FILTER (c < 2), 0) / sum(v) * 100 + 0.5) ELSE 0 END AS percent FROM l GROUP BY l_orderkey""",
    "asset_files": "SELECT p_partkey AS file_id, p_partkey % 4 < 2 AS associated, p_partkey % 4 = 1 AS multi FROM part WHERE lower(p_name) LIKE '%all%' OR lower(p_type) LIKE '%all%'",
    "overlaid_assets": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '7' WHEN p_partkey % 3 = 0 THEN 'saved' ELSE CAST(p_size AS VARCHAR) END AS quantity, p_partkey % 5 = 0 AS overridden FROM part",
    "photo_misses": """WITH a AS (SELECT p_partkey AS room_id, unnest([0, 1, 2]) AS place, unnest([p_partkey * 2, p_partkey + 1, -p_partkey]) AS file_id FROM part)
SELECT room_id, place, file_id, o_orderkey IS NOT NULL AS found FROM a LEFT JOIN orders ON o_orderkey = file_id AND o_orderkey % 3 <> 1""",
    "chunk_order": """SELECT o_custkey AS doc_id, o_orderkey AS chunk_id, o_orderkey % 4 AS start, CASE WHEN o_orderkey % 3 = 0 THEN 'table_summary' ELSE 'text' END AS chunk_type,
CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4, CAST(o_orderkey % 3 = 0 AS INT), CAST(o_orderkey AS VARCHAR)) AS INT) AS place FROM orders""",
    "chunk_tables": """SELECT s_suppkey AS chunk_id, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AS is_table, '| Nation | Region |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' | ' || n_regionkey || ' |' AS markdown
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND s_suppkey % 3 <> 0 AND n_nationkey % 5 <> 0""",
    "text_scalars": r"""SELECT p_partkey, regexp_extract(p_name, '(\w+)$', 1) AS last_word, CAST(CAST('1' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS DOUBLE) AS DOUBLE) AS number, regexp_replace(lower(p_name) || ' (a)', '[^a-z0-9]+', '_', 'g') AS snake,
CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST('1' || p_size AS BIGINT) END AS money, substr(p_name, 1, 7) AS excerpt FROM part""",
}
