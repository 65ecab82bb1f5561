"""Queries over detector and model answers, keys, and checks of rows and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import checks

PROMPTS = ["view", "purchase order", "sign"]
EXACT = {"Property Address": "subject.property_address", "Borrower": "subject.borrower"}
#: Keys of forms as they are written, the last two name no field.
KEYS = ["property address", " BORROWER ", "Site Address", "Last sale price", "Yr Built", "Year", "GLA (sq ft)", "Appraised Value", "Lender", ""]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detector_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each event: objects, arrays, three forms of box, broken boxes and broken JSON."""
    box = "concat('[', event_id % 7 / 10, ', 0.25, ', event_id % 9 * 50, ', ', event_id % 4, ']')"
    one = f"concat('{{\"label\": \"', event_type, '\", \"confidence\": 0.5, \"box\": ', {box}, '}}, {{\"class\": \"Signup form\", \"score\": 0.25, \"bbox\": [0, 0, 1]}}, {{\"x_min\": 0.5}}')"
    text = f"CASE event_id % 3 WHEN 0 THEN concat('[', {one}, ']') WHEN 1 THEN concat('{{\"detections\": [', {one}, ']}}') ELSE '[{{\"label\"' END"
    found = checks.detections(_table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS answer"), "event_id", "answer", PROMPTS)
    return found.select("id", "place", "label", "confidence", "prompt", *[F.round(F.col("box")[k], 6).alias(k) for k in ("x_min", "y_max")], F.round(F.col("box")["x_max"], 6).alias("x_max"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a fence, bare and broken, with confidences out of range and empty values."""
    body = "concat('{\"price\": {\"value\": \"', o_custkey, '\", \"confidence\": ', o_orderkey % 30 / 10 - 1, '}, \"status\": {\"value\": \"', o_orderstatus, '\"}, \"none\": {\"value\": null, \"confidence\": 1}, \"note\": \"x\"}')"
    text = f"CASE o_orderkey % 3 WHEN 0 THEN concat('Here:\n```json\n', {body}, '\n```\n') WHEN 1 THEN {body} ELSE 'no answer' END"
    return checks.answered_fields(_table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS answer"), "o_orderkey", "answer").withColumn("confidence", F.round("confidence", 6))


def keyed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as pairs of a form."""
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), F.expr(f"cast((l_partkey + l_linenumber) % {len(KEYS)} as int) + 1"))
    seq = F.col("l_linenumber") * F.lit(1_000_000) + F.col("l_partkey")
    return checks.keyed_fields(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), seq.alias("seq"), key.alias("key"), F.col("l_partkey").cast("string").alias("value")), EXACT)


def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as takeoffs and assets with faults."""
    rows = _table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CAST(p_partkey AS string) AS id", "CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS name", "CASE WHEN p_partkey % 7 > 0 THEN p_type END AS description",
        "p_size - 5 AS quantity", "element_at(array('5-year', '15-year', '27.5-year', '7-year'), CAST(p_partkey % 4 AS int) + 1) AS category",
        "p_size - 3 AS value", "p_size - 2 AS period", "p_size * 3 AS percentage", "p_size * 30 AS area", "p_size * p_partkey % 3000 AS basement",
    )
    warned = F.array_join(checks.area_warnings(F.col("area"), F.col("basement")), ",")
    return rows.select("p_partkey", checks.takeoff_fault().alias("takeoff"), checks.asset_fault().alias("asset"), warned.alias("areas"), checks.class_years(F.col("category")).alias("years"))


def checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that a part's number has as bits are saved as verified."""
    bits = F.map_from_arrays(F.array(*[F.lit(s) for s in checks.CHECKLIST]), F.array(*[(F.shiftright("p_partkey", i).bitwiseAND(F.lit(1)) == 1) for i in range(len(checks.CHECKLIST))]))
    return _table(spark, sf_dir, "part").select("p_partkey", checks.checklist(bits).alias("c")).select("p_partkey", "c.*")


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS study_id", "l_linenumber AS id", "l_linenumber AS seq", "l_returnflag = 'R' AS verified").distinct()


def next_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U21."""
    return checks.next_unverified(_assets(spark, sf_dir).groupBy("study_id", "id", "seq").agg(F.min("verified").alias("verified")))


def verify_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U21."""
    return checks.progress(_assets(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (detector_answers, model_answers, keyed_fields, row_checks, checklists, next_unverified, verify_progress)}

_KEY = "trim(lower([" + ", ".join(f"'{k}'" for k in KEYS) + f"][CAST((l_partkey + l_linenumber) % {len(KEYS)} AS INT) + 1]))"
_KEYED = " ".join([f"WHEN k = '{k.lower()}' THEN '{f}'" for k, f in EXACT.items()] + [f"WHEN contains(k, '{k}') THEN '{f}'" for k, f in checks.KEY_PARTS])
_BITS = " + ".join(f"((p_partkey >> {i}) & 1)" for i in range(len(checks.CHECKLIST) - 1))
ORACLE_SQL: dict[str, str] = {
    "detector_answers": """WITH e AS (SELECT *, greatest(CAST(event_id % 7 AS DOUBLE) / 10, 0.25, event_id % 9 * 50, event_id % 4) > 1 AS px FROM events WHERE event_id % 3 < 2)
SELECT event_id AS id, 0 AS place, event_type AS label, 0.5::DOUBLE AS confidence, CASE event_type WHEN 'purchase' THEN 'purchase order' WHEN 'signup' THEN 'sign' ELSE 'view' END AS prompt,
round(CAST(event_id % 7 AS DOUBLE) / 10 / CASE WHEN px THEN 640 ELSE 1 END, 6) AS x_min, round(CAST(event_id % 9 * 50 AS DOUBLE) / CASE WHEN px THEN 640 ELSE 1 END, 6) AS x_max, round(CAST(event_id % 4 AS DOUBLE) / CASE WHEN px THEN 480 ELSE 1 END, 6) AS y_max FROM e
UNION ALL SELECT event_id, 2, 'unknown', 0, 'view', 0.5, 1, 1 FROM e""",
    "model_answers": """SELECT o_orderkey AS id, 'price' AS key, CAST(o_custkey AS VARCHAR) AS value, round(least(1, greatest(0, CAST(o_orderkey % 30 AS DOUBLE) / 10 - 1)), 6) AS confidence FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT o_orderkey, 'status', o_orderstatus, 0.7 FROM orders WHERE o_orderkey % 3 < 2""",
    "keyed_fields": f"""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS seq, l_partkey, {_KEY} AS k FROM lineitem), f AS (SELECT *, CASE {_KEYED} END AS field FROM p)
SELECT doc_id, field, CAST(arg_max(l_partkey, seq) AS VARCHAR) AS value FROM f WHERE field IS NOT NULL GROUP BY doc_id, field""",
    "row_checks": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'description' WHEN p_size < 5 THEN 'quantity' END AS takeoff,
CASE WHEN p_partkey % 5 = 0 THEN 'name' WHEN p_partkey % 7 = 0 THEN 'description' WHEN p_partkey % 4 = 3 THEN 'category' WHEN p_size < 3 THEN 'value' WHEN p_size > 33 THEN 'percentage' END AS asset,
concat_ws(',', CASE WHEN p_size * 30 < 100 THEN 'small' END, CASE WHEN p_size * p_partkey % 3000 > p_size * 45 THEN 'basement' END) AS areas, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 15 WHEN 2 THEN 27 ELSE 7 END AS years FROM part""",
    "checklists": f"""WITH b AS (SELECT p_partkey, {_BITS} AS n, (p_partkey >> 7) & 1 = 1 AS o FROM part), c AS (SELECT p_partkey, n, o OR n = 7 AS overall FROM b)
SELECT p_partkey, CAST(n + CAST(overall AS INT) AS INT) AS verified, floor((n + CAST(overall AS INT)) * 100.0 / 8 + 0.5)::DOUBLE AS percent, overall FROM c""",
    "next_unverified": """WITH a AS (SELECT l_orderkey AS study_id, l_linenumber AS id FROM lineitem GROUP BY ALL HAVING NOT bool_and(l_returnflag = 'R'))
SELECT study_id, id, coalesce(lead(id) OVER w, first(id) OVER w) AS next_id FROM a WINDOW w AS (PARTITION BY study_id ORDER BY id)""",
    "verify_progress": """WITH a AS (SELECT DISTINCT l_orderkey AS study_id, l_linenumber, l_returnflag = 'R' AS v FROM lineitem)
SELECT study_id, count(*) AS n, count(*) FILTER (v) AS verified, floor(count(*) FILTER (v) * 100.0 / count(*) + 0.5)::DOUBLE AS percent FROM a GROUP BY study_id""",
}
