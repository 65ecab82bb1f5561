"""Queries over takeoffs, studies, files, manifests and change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellum.functions.text import half_up
from tessellum.operators import takeoffs
from tessellum.operators.evidence import merge_by_id
from tessellum.sources import files
from tessellum.streaming import changes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _takeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are takeoffs of parts: a class is a part's type, a room its brand; some costs are missing."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("description"), F.col("p_type").alias("class"), F.col("p_brand").alias("room"), F.col("p_retailprice").alias("unit_cost"))
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") * 100).alias("takeoff_cost"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey")


def cost_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 U8."""
    return _takeoffs(spark, sf_dir).agg(takeoffs.total_cost())


def class_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5 U9."""
    return takeoffs.by_class(_takeoffs(spark, sf_dir), "class")


def takeoff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1."""
    found = takeoffs.filtered(_takeoffs(spark, sf_dir), equal={"room": "Brand#1", "class": "all"}, search="RING", fields=["description", "class", "room"])
    return found.select("l_orderkey", "l_linenumber", "description", "class", "room")


def takeoff_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest takeoffs of each room, nulls last, as a top-k report."""
    order = Window.partitionBy("room").orderBy(*takeoffs.sort_keys("takeoff_cost", descending=True), "l_orderkey", "l_linenumber")
    ranked = _takeoffs(spark, sf_dir).withColumn("place", F.row_number().over(order))
    return ranked.where("place <= 5").select("room", "place", "l_orderkey", "l_linenumber")


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different classes and rooms."""
    each = _takeoffs(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("class").alias("facet"), F.col("class").alias("value")), F.struct(F.lit("room").alias("facet"), F.col("room").alias("value")))).alias("f"))
    return each.select("f.*").distinct()


def cost_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(material + labor) * quantity * location * quality in cents, a null estimate skipped in totals but counted."""
    quality = F.element_at(F.array(*map(F.lit, (0.8, 1.0, 1.25, 1.5))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    cost = (F.col("takeoff_cost") + F.col("unit_cost")) * F.col("quantity") * 1.05 * quality
    rows = _takeoffs(spark, sf_dir).groupBy("class")
    return rows.agg(F.count("*").alias("n"), F.count("takeoff_cost").alias("n_estimates"), F.sum(F.floor(cost + 0.5).cast("long")).alias("total"))


def study_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished studies (orders of status F), and 5 and 3 percent of their value."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    done = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").agg(F.count("*").alias("completed"), cents.alias("cents"))
    return done.select("completed", half_up(F.col("cents") * 0.05 / 100).alias("savings"), half_up(F.col("cents") * 0.03 / 100).alias("fees"))


def studies_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest studies, 50 at most."""
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    rows = _table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(order)).where("place <= 50")
    named = rows.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return named.select("c_name", "o_orderkey", "place")


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies and open ones by segment."""
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.countDistinct("o_custkey").alias("users"))


def status_highwater(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's status never falls back: the furthest step so far at each event."""
    steps = ("view", "click", "signup", "purchase")
    step = F.coalesce(F.array_position(F.array(*map(F.lit, steps)), F.col("event_type")), F.lit(0))
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _table(spark, sf_dir, "events").select("event_id", F.max(step).over(so_far).cast("long").alias("furthest"))


def unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16: parts that no first line of an order of more than 47 pieces takes."""
    taken = _table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_quantity > 47")
    return _table(spark, sf_dir, "part").join(taken, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


def photo_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's documents, the percent that has a label; 100 if there are none."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    seen = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled")).distinct()
    rows = docs.join(seen, F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("source").agg(half_up(F.count("labelled") * 100 / F.count("*")).alias("percent"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number read from JSON, null where it is malformed; a part of G12 and W5."""
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents registered, those of even sources again with another size."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("size"), F.lit(1).alias("version"))
    again = docs.where(F.substring("source", 4, 9).cast("int") % 2 == 0).withColumn("size", F.col("size") + 1).withColumn("version", F.lit(2))
    return merge_by_id(docs, again, "doc_id", "version")


def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, against those of ids not divisible by 7 with every eleventh a byte longer."""
    here = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.length("html").alias("size"), "page_id")
    there = here.where("page_id % 7 <> 0").withColumn("size", F.col("size") + F.when(F.col("page_id") % 11 == 0, 1).otherwise(0))
    return files.inventory_diff(here.where("page_id % 5 <> 0").select("path", "size"), there.select("path", "size"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changes of each user's event type."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return changes.changes(rows, "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type")


def debounce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of a user that none follows within an hour."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return changes.debounced(rows, "user_id", "ts", 3600, ["ts", "event_id"]).select("event_id")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by hour and type."""
    return changes.windowed_counts(_table(spark, sf_dir, "events"), "ts", "event_type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (cost_total, class_groups, takeoff_filter, takeoff_rank, facets, cost_aggregate, study_stats, studies_by_user, status_summary, status_highwater,
              unassigned, photo_progress, json_props, manifest_upsert, inventory_diff, change_feed, debounce_last, hourly_counts)
}

_T = """t AS (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax * 100 END AS takeoff_cost, p_name AS description, p_type AS class, p_brand AS room, p_retailprice AS unit_cost
FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_COST = "CAST(sum(CAST(round(coalesce(takeoff_cost, unit_cost, 0) * coalesce(quantity, 0) * 100) AS BIGINT)) AS BIGINT)"
ORACLE_SQL: dict[str, str] = {
    "cost_total": f"WITH {_T} SELECT {_COST} AS total_cents FROM t",
    "class_groups": f"""WITH {_T}, g AS (SELECT class, count(*) AS n, {_COST} AS total_cents FROM t GROUP BY class)
SELECT class, n, total_cents, floor(total_cents * 100 / (SELECT sum(total_cents) FROM g) * 100 + 0.5) / 100 AS percent FROM g""",
    "takeoff_filter": f"WITH {_T} SELECT l_orderkey, l_linenumber, description, class, room FROM t WHERE room = 'Brand#1' AND contains(lower(concat_ws(' ', description, class, room)), 'ring')",
    "takeoff_rank": f"""WITH {_T} SELECT room, place, l_orderkey, l_linenumber FROM (SELECT *, CAST(row_number() OVER (PARTITION BY room ORDER BY takeoff_cost DESC NULLS LAST, l_orderkey, l_linenumber) AS INT) AS place FROM t) WHERE place <= 5""",
    "facets": "SELECT DISTINCT 'class' AS facet, p_type AS value FROM part JOIN lineitem ON l_partkey = p_partkey UNION SELECT DISTINCT 'room', p_brand FROM part JOIN lineitem ON l_partkey = p_partkey",
    "cost_aggregate": f"""WITH {_T} SELECT class, count(*) AS n, count(takeoff_cost) AS n_estimates,
CAST(sum(CAST(floor((takeoff_cost + unit_cost) * quantity * CAST(1.05 AS DOUBLE) * CAST(([0.8, 1.0, 1.25, 1.5])[l_linenumber % 4 + 1] AS DOUBLE) + 0.5) AS BIGINT)) AS BIGINT) AS total FROM t GROUP BY class""",
    "study_stats": """WITH s AS (SELECT count(*) AS completed, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS c FROM orders WHERE o_orderstatus = 'F')
SELECT completed, floor(c * 0.05 / 100 + 0.5) AS savings, floor(c * 0.03 / 100 + 0.5) AS fees FROM s""",
    "studies_by_user": """SELECT c_name, o_orderkey, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS place FROM orders) JOIN customer ON o_custkey = c_custkey WHERE place <= 50""",
    "status_summary": "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(DISTINCT o_custkey) AS users FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "status_highwater": """SELECT event_id, CAST(max(coalesce(list_position(['view', 'click', 'signup', 'purchase'], event_type), 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS furthest FROM events""",
    "unassigned": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_linenumber = 1 AND l_quantity > 47)",
    "photo_progress": "SELECT source, floor(count(l.doc_id) * 100 / count(*) + 0.5) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source",
    "json_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "manifest_upsert": "SELECT doc_id, source, n_chars + CASE WHEN e THEN 1 ELSE 0 END AS size, CASE WHEN e THEN 2 ELSE 1 END AS version FROM (SELECT *, CAST(substr(source, 4) AS INT) % 2 = 0 AS e FROM documents)",
    "inventory_diff": """WITH h AS (SELECT page_id AS i, length(html) AS s FROM pages WHERE page_id % 5 <> 0), r AS (SELECT page_id AS i, length(html) + CAST(page_id % 11 = 0 AS INT) AS s FROM pages WHERE page_id % 7 <> 0)
SELECT CAST(coalesce(h.i, r.i) AS VARCHAR) AS path, CASE WHEN r.i IS NULL THEN 'missing' WHEN h.i IS NULL THEN 'extra' ELSE 'size' END AS state FROM h FULL JOIN r ON h.i = r.i WHERE r.i IS NULL OR h.i IS NULL OR h.s <> r.s""",
    "change_feed": """SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1 OR b IS DISTINCT FROM event_type""",
    "debounce_last": "SELECT event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) WHERE a IS NULL OR epoch_us(a) - epoch_us(ts) > 3600000000",
    "hourly_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
