"""Queries over feeds: streams that are run to their end over the events, in turns, and autosaved edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.sources import state
from tessellum.sources.tables import table
from tessellum.streaming import feeds

TURNS, TIMEOUT = 3, 8 * 3600


def _streamed(rows: DataFrame, turn: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a stream over rows that come in turns, by their column of that name."""
    spark = rows.sparkSession
    feeds.stateful(spark)
    folder = state.scratch(spark, "feed")
    for k in range(TURNS):  # one after the other, so that files are read in this order
        rows.where(F.col(turn) == k).drop(turn).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.drop(turn).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = of(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _in_turns(rows: DataFrame) -> DataFrame:
    """Events with the turn in which they come: thirds of their time."""
    span = rows.agg(F.min("ts").alias("_low"), F.max("ts").alias("_high"))
    part = (F.unix_micros("ts") - F.unix_micros("_low")) / (F.unix_micros("_high") - F.unix_micros("_low") + 1) * TURNS
    return rows.join(F.broadcast(span)).withColumn("turn", F.floor(part).cast("int")).drop("_low", "_high")


def subscription_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 F2: each user's event types as a subscription, a stream in three turns."""
    rows = _in_turns(_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")).drop("ts")
    return _streamed(rows, "turn", lambda s: feeds.subscribed(s, "user_id", "event_id", "event_type"))


def poll_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users polled until they buy for a large sum, eight hours at most; a stream in three turns, ended by a row a year later."""
    events = _events(spark, sf_dir)
    rows = _in_turns(events.select("user_id", "ts", ((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("bought")))
    end = rows.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(None).cast("boolean").alias("bought"), F.lit(TURNS - 1).alias("turn"))
    found = _streamed(rows.unionByName(end), "turn", lambda s: feeds.polled(s, "user_id", "ts", "bought", TIMEOUT))
    return found.where("user_id >= 0").select("user_id", "outcome", F.col("at").cast("timestamp_ntz").alias("at"), "waited")


def autosaved_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a user's views are edits of their own, other events come from elsewhere: those within ten minutes after a view go, the rest is saved when an hour is quiet."""
    events = _events(spark, sf_dir).where("user_id IS NOT NULL").select("user_id", "ts", "event_id", "event_type")
    own = events.where("event_type = 'view'")
    kept = feeds.without_echoes(events.where("event_type <> 'view'"), own, "user_id", "ts", 600)
    found = feeds.autosaved(own.unionByName(kept), "user_id", "ts", "event_id", "1 hour")
    return found.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "event_id", "edits")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (subscription_feed, poll_outcomes, autosaved_edits)}
ORACLE_SQL: dict[str, str] = {
    "subscription_feed": """WITH c AS (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS k FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CASE WHEN k = 1 THEN 'snapshot' ELSE 'change' END AS kind, event_id, event_type FROM c WHERE k = 1 OR b IS DISTINCT FROM event_type""",
    "poll_outcomes": f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, coalesce(event_type = 'purchase' AND value > 100, false) AS b FROM events WHERE user_id >= 0), f AS (SELECT user_id, min(ms) AS first FROM e GROUP BY 1),
m AS (SELECT e.user_id, min(ms) AS met FROM e JOIN f ON e.user_id = f.user_id WHERE b AND ms < first + {TIMEOUT * 1000} GROUP BY 1)
SELECT f.user_id, CASE WHEN met IS NULL THEN 'timed_out' ELSE 'done' END AS outcome, make_timestamp(1000 * coalesce(met, first + {TIMEOUT * 1000})) AS at, CAST((coalesce(met, first + {TIMEOUT * 1000}) - first) / 1000.0 AS DOUBLE) AS waited FROM f LEFT JOIN m ON f.user_id = m.user_id""",
    "autosaved_edits": """WITH e AS (SELECT *, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL), v AS (SELECT * FROM e WHERE event_type = 'view'),
k AS (SELECT * FROM v UNION ALL SELECT * FROM e WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM v WHERE v.user_id = e.user_id AND e.t >= v.t AND e.t < v.t + 600000000)),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600000000 THEN 0 ELSE 1 END AS starts FROM k), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, make_timestamp(max(t)) AS at, arg_max(event_id, (t, event_id)) AS event_id, count(*) AS edits FROM s GROUP BY user_id, run""",
}
