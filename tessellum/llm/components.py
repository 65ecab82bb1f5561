"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import checkpointed


#: Links of one task, some 4 MB: a small table is worked on in few tasks, whatever the number of shuffle partitions.
LINKS = 250_000


def _least(links: DataFrame, tasks: int) -> DataFrame:
    """(a, m): the least b of each a, dealt out again, so that a join with it has two plain shuffles and a hub's side can be split."""
    return links.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks).repartition("a")


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    least = _least(both, tasks).select("a", F.least("m", "a").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = _least(down, tasks)
    to_least = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks)


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b) links between long ids -> (id, component): the least id reachable, for every id that has a link.

    Links to oneself, repeated links and either direction are fine; rows with a null end are no links.
    Each round is two joins on a key whose links are summed up in the map tasks first; the links of a hub go through the
    joins in as many tasks as adaptive execution splits a skewed partition into. Rounds grow with the logarithm of a
    component's width, tasks with the number of links. No links: an empty table.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    links = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = 1 + links.count() // LINKS
    links, was = links.coalesce(tasks), None
    for _ in range(max_rounds):
        # no round makes more links than it was given
        links = checkpointed(_small_star(_large_star(links, tasks), tasks))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
