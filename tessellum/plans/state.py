"""Queries over keyed state tables: checkpoints, documents with updates, results written back, files of studies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellum.operators import writeback
from tessellum.sources import state
from tessellum.sources.tables import table

NOW = "2024-03-01 00:00:00"


def _at(day: int) -> str:
    return f"2024-02-{day:02d} 06:00:00"


def checkpoint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as checkpoints, put in three turns, some threads deleted before the last; the type isn't JSON."""
    points = state.Checkpoints(spark, state.scratch(spark, "checkpoints"))
    values = F.create_map(F.lit("props"), "props", F.lit("type"), "event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("thread_id"), F.lit(1).alias("v"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("ts"),
        values.alias("channel_values"), F.lit("loop").alias("source"), F.col("event_id").cast("int").alias("step"),
    )
    for turn in range(3):
        if turn == 2:
            points.delete(rows.select("thread_id").where("cast(thread_id AS long) % 10 = 3"))
        points.put(rows.where(F.col("step") % 3 == turn), F.lit(_at(turn + 1)).cast("timestamp"), order="step")
    asked = rows.select("thread_id").distinct()
    ages = points.age(asked, F.lit(NOW).cast("timestamp")).select(F.col("thread_id").alias("of"), "age")
    found = points.get(asked).join(ages, F.col("thread_id") == F.col("of"))
    return found.select("thread_id", "found", "id", "step", F.col("channel_values")["props"].alias("props"), F.col("channel_values")["type"].alias("type"), "age")


def study_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, updated by their orders, by a finding with evidence and by a finished stage; some updates are of no document."""
    studies = state.Studies(spark, state.scratch(spark, "studies"))
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    at = lambda day: F.lit(_at(day)).cast("timestamp")
    studies.create(writeback.fields(customers, "c_custkey", {"name": F.col("c_name"), "workflowStatus": F.lit("new"), "orders": F.lit(0)}), at(1))
    counted = orders.groupBy((F.col("o_custkey") * F.when(F.col("o_custkey") % 7 == 0, -1).otherwise(1)).alias("id")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    studies.update(writeback.fields(counted, "id", {"orders": F.col("n"), "last": F.struct("last")}), at(2))
    poor = customers.where("c_acctbal < 0").select(
        "c_custkey", "c_mktsegment", F.array(F.struct(F.lit("customer").alias("table"), F.col("c_custkey").alias("row"))).alias("citations"),
        F.when(F.col("c_custkey") % 2 == 0, 0.5).alias("confidence"), (F.col("c_custkey") % 3 == 0).alias("needs_review"), F.when(F.col("c_custkey") % 3 == 0, "no evidence").alias("review_reason"),
    )
    studies.update(writeback.with_evidence(poor, "c_custkey", "segment", F.col("c_mktsegment"), "v1", at(3)), at(3))
    studies.update(writeback.stage_complete(customers.where("c_custkey % 4 = 1"), "c_custkey", "rooms", "objects_ready", F.struct(F.lit(3).alias("rooms")), at(4)), at(4))
    studies.update(writeback.advanced(customers.where("c_custkey % 8 = 1"), "c_custkey", F.concat(F.lit("at "), "c_mktsegment")), at(5))
    read = studies.read().select("id", F.explode("fields").alias("field", "value"))
    return read.withColumn("value", F.when(F.col("field") == "updatedAt", F.substring(F.get_json_object("value", "$.at"), 1, 10)).otherwise(F.col("value")))


def object_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as classified objects, put in two turns of which the second changes some, then some deleted; a summary an order."""
    first = [F.max(c).alias(c) for c in ("l_discount", "l_tax", "l_returnflag")]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*first)  # numbers repeat
    lines = lines.select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).alias("needs_review"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("confidence"), "l_returnflag")
    objects = state.KeyedTable(spark, state.scratch(spark, "objects"), "study long, object long, needs_review boolean, confidence double", ["study", "object"])
    named = writeback.reviewed(lines).select(F.col("l_orderkey").alias("study"), F.col("l_linenumber").alias("object"), "needs_review", "confidence", "l_returnflag")
    objects.put(named.where("object <= 4"))
    objects.put(named.where("object >= 4").withColumn("needs_review", ~F.col("needs_review")))
    objects.delete(named.where("object = 2 AND l_returnflag = 'R'"))
    at = F.lit(_at(1)).cast("timestamp")
    return writeback.summaries(objects.read(), "study", "classification_summary", at, sure=F.round(F.sum(F.round(F.col("confidence") * 100)), 0).cast("long"))


def study_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as files: the closed ones are there, the open ones come after the last, in order of their key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    files = orders.where("o_orderstatus <> 'O'").withColumn("place", place).select("o_custkey", "place", "o_orderkey")
    return writeback.uploaded(files, orders.where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (checkpoint_states, study_updates, object_writeback, study_files)}

_DAY = "CAST('{}' AS TIMESTAMP)"
ORACLE_SQL: dict[str, str] = {
    "checkpoint_states": f"""WITH e AS (SELECT user_id, event_id % 3 AS turn, max(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
k AS (SELECT user_id, max(turn) AS turn FROM e WHERE turn = 2 OR user_id % 10 <> 3 GROUP BY user_id), l AS (SELECT k.user_id, e.turn, v.* FROM k JOIN e ON e.user_id = k.user_id AND e.turn = k.turn JOIN events v ON v.event_id = e.event_id),
u AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)
SELECT CAST(u.user_id AS VARCHAR) AS thread_id, event_id IS NOT NULL AS found, CAST(event_id AS VARCHAR) AS id, CAST(event_id AS INT) AS step, props, event_type AS type, CAST(epoch({_DAY.format(NOW)} - {_DAY.format(_at(1))}) - 86400 * turn AS DOUBLE) AS age FROM u LEFT JOIN l ON l.user_id = u.user_id""",
    "study_updates": f"""WITH c AS (SELECT *, c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_custkey % 7 <> 0 OR o_custkey = 0 GROUP BY 1),
j AS (SELECT c.*, o.n, o.last, coalesce(c_acctbal < 0, false) AS poor FROM c LEFT JOIN o ON o.k = c.k)
SELECT CAST(k AS VARCHAR) AS id, 'name' AS field, '"' || c_name || '"' AS value FROM j
UNION ALL SELECT CAST(k AS VARCHAR), 'workflowStatus', CASE WHEN k % 8 = 1 THEN '"at ' || c_mktsegment || '"' WHEN k % 4 = 1 THEN '"objects_ready"' ELSE '"new"' END FROM j
UNION ALL SELECT CAST(k AS VARCHAR), 'orders', CAST(coalesce(n, 0) AS VARCHAR) FROM j UNION ALL SELECT CAST(k AS VARCHAR), 'last', '{{"last":' || last || '}}' FROM j WHERE n IS NOT NULL
UNION ALL SELECT CAST(k AS VARCHAR), 'segment', '"' || c_mktsegment || '"' FROM j WHERE poor
UNION ALL SELECT CAST(k AS VARCHAR), 'segment_metadata', '{{"citations":[{{"table":"customer","row":' || k || '}}],"confidence":' || CASE WHEN k % 2 = 0 THEN '0.5' ELSE 'null' END || ',"needs_review":' || (k % 3 = 0) || ',"review_reason":'
 || CASE WHEN k % 3 = 0 THEN '"no evidence"' ELSE 'null' END || ',"agent_version":"v1","updated_at":"{_at(3).replace(' ', 'T')}Z"}}' FROM j WHERE poor
UNION ALL SELECT CAST(k AS VARCHAR), 'rooms_completed_at', '"{_at(4).replace(' ', 'T')}Z"' FROM j WHERE k % 4 = 1 UNION ALL SELECT CAST(k AS VARCHAR), 'rooms_summary', '{{"rooms":3}}' FROM j WHERE k % 4 = 1
UNION ALL SELECT CAST(k AS VARCHAR), 'updatedAt', CASE WHEN k % 8 = 1 THEN '{_at(5)[:10]}' WHEN k % 4 = 1 THEN '{_at(4)[:10]}' WHEN poor THEN '{_at(3)[:10]}' WHEN n IS NOT NULL THEN '{_at(2)[:10]}' ELSE '{_at(1)[:10]}' END FROM j""",
    "object_writeback": f"""WITH g AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 4 THEN NOT coalesce(l_discount > 0.05, false) ELSE coalesce(l_discount > 0.05, false) END AS r, CASE WHEN l_tax > 0.02 THEN l_tax ELSE 0 END AS c FROM g WHERE NOT (l_linenumber = 2 AND l_returnflag = 'R'))
SELECT CAST(l_orderkey AS VARCHAR) AS id, 'classification_summary' AS field, '{{"total":' || count(*) || ',"needs_review":' || count(*) FILTER (r) || ',"sure":' || CAST(sum(round(c * 100)) AS BIGINT) || ',"completed_at":"{_at(1).replace(' ', 'T')}Z"}}' AS value FROM l GROUP BY l_orderkey""",
    "study_files": """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', o_orderkey) - 1 AS INT) AS place, o_orderkey FROM orders""",
}
