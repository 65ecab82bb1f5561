"""Queries over the store of artifacts and over corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import codes, text
from tessellum.operators import artifacts, studies
from tessellum.sources import state
from tessellum.sources.tables import table


def artifact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as artifacts, saved, updated, reviewed and deleted, each also by unknown ids; the pending queue."""
    events = table(spark, sf_dir, "events")
    k = F.col("event_id")
    priority = F.when(k % 5 > 0, (k * 37 % 100) / 100)
    store = artifacts.Artifacts(spark, state.scratch(spark, "artifacts"))
    store.save(events.select(k.alias("artifact_id"), F.col("user_id").alias("image_id"), F.col("event_type").alias("component"), (k % 90 / 100).alias("confidence"), priority.alias("priority")))
    store.update(events.where("event_id % 7 = 0").select((k * F.when(k % 2 == 0, -1).otherwise(1)).alias("artifact_id"), F.lit("door").alias("component"), F.lit(None).cast("double").alias("confidence")))
    store.review(events.where("event_id % 3 = 0").select(k.alias("artifact_id"), F.when(k % 2 == 0, False).alias("approved"), F.lit("seen").alias("notes")))
    store.delete(events.where("event_id % 11 = 0").select((k + F.when(k % 2 == 0, 10_000_000).otherwise(0)).alias("artifact_id")))
    return artifacts.queue(store.all()).select("artifact_id", "image_id", "component", "confidence", "priority")


def correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as corrections, the line's status being the field and its flag the engineer; those of one field and of all."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.col("l_returnflag").alias("engineer"), F.col("l_linestatus").alias("field"))
    one = artifacts.correction_counts(artifacts.corrections(rows, field="O")).withColumn("of", F.lit("O"))
    return artifacts.correction_counts(rows).withColumn("of", F.lit("all")).unionByName(one)


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of customers as money, numbers and percents, dates of orders, and labels in two cases."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    balance, k = F.col("c_acctbal"), F.col("o_orderkey")
    label = F.when(k % 2 == 0, F.concat(F.lit("total_"), F.lower("c_mktsegment"), F.lit("_value"))).otherwise(F.concat(F.lit("netValueOf"), F.initcap("c_mktsegment")))
    return rows.select(
        "o_orderkey", codes.display_money(balance).alias("money"), codes.display_number((k * 997 % 100_000_000) / F.when(k % 2 == 0, 1000).otherwise(16) * F.when(k % 5 == 0, -1).otherwise(1)).alias("number"),
        codes.display_percent(k % 1000 / 10 + 0.02).alias("percent"), codes.display_date(F.col("o_orderdate")).alias("date"), text.prettify(label).alias("label"),
    )


def evidence_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as citations of the order's customer, in order of their number; orders without lines have none."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda c: F.concat_ws(":", c["l_partkey"], c["l_suppkey"])).alias("citations"))
    items = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("name", F.concat(F.lit("order of "), "o_custkey"))
    return studies.evidence_rows(items, "o_orderkey", "name", "citations")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (artifact_store, correction_counts, display_values, evidence_listing)}
_ONE = "WHERE l_linestatus = 'O'"
_BOTH = "SELECT 'field' AS kind, l_linestatus AS name, count(*) AS n, '{0}' AS of FROM l {1} GROUP BY ALL UNION ALL SELECT 'engineer', l_returnflag, count(*), '{0}' FROM l {1} GROUP BY ALL"
ORACLE_SQL: dict[str, str] = {
    "artifact_store": """SELECT event_id AS artifact_id, user_id AS image_id, CASE WHEN u THEN 'door' ELSE event_type END AS component, CASE WHEN NOT u THEN event_id % 90 / 100 END AS confidence, (event_id * 37 % 100) / 100 AS priority
FROM (SELECT *, event_id % 7 = 0 AND (event_id % 2 = 1 OR event_id = 0) AS u FROM events) WHERE event_id % 5 > 0 AND event_id % 3 <> 0 AND NOT (event_id % 11 = 0 AND event_id % 2 = 1)""",
    "correction_counts": f"WITH l AS (SELECT * FROM lineitem) {_BOTH.format('all', '')} UNION ALL {_BOTH.format('O', _ONE)}",
    "display_values": r"""WITH r AS (SELECT o_orderkey AS k, o_orderdate, c_acctbal AS b, c_mktsegment AS m, (o_orderkey * 997 % 100000000) / CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 16 END AS v FROM orders JOIN customer ON o_custkey = c_custkey),
x AS (SELECT *, CAST(floor(v * 1000 + 0.5) AS BIGINT) AS t FROM r)
SELECT k AS o_orderkey, CASE WHEN b < 0 THEN '-' ELSE '' END || '$' || format('{:,}', CAST(floor(abs(b) + 0.5) AS BIGINT)) AS money,
CASE WHEN k % 5 = 0 AND v > 0 THEN '-' ELSE '' END || format('{:,}', t // 1000) || CASE WHEN t % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(t % 1000 AS VARCHAR), 3, '0'), '0') END AS number,
printf('%.1f%%', k % 1000 / 10 + 0.02) AS percent, strftime(o_orderdate, '%b %-d, %Y') AS date, CASE WHEN k % 2 = 0 THEN 'Total ' || upper(m[1]) || lower(m[2:]) || ' Value' ELSE 'Net Value Of ' || upper(m[1]) || lower(m[2:]) END AS label FROM x""",
    "evidence_listing": """SELECT o_orderkey, 'order of ' || o_custkey AS name, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS place, l_partkey || ':' || l_suppkey AS citation FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
}
