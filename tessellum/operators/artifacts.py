"""Artifacts as a keyed table: reads, partial updates, deletes and reviews that say what they found; the review queue; corrections by what they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.sources.state import KeyedTable


class Artifacts:
    """Artifacts by their id."""

    SCHEMA = "artifact_id long, image_id long, component string, confidence double, priority double, reviewed boolean, approved boolean, notes string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = KeyedTable(spark, path, self.SCHEMA, ["artifact_id"])

    def save(self, rows: DataFrame) -> int:
        """Rows as SCHEMA, columns that are missing being null; those of known ids replace them."""
        given = {c.lower() for c in rows.columns}
        return self.table.put(rows.select(*[F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in self.table.schema.fields]))

    def all(self, image_id: int | None = None) -> DataFrame:
        rows = self.table.read()
        return rows if image_id is None else rows.where(F.col("image_id") == image_id)

    def update(self, changes: DataFrame) -> DataFrame:
        """(artifact_id, found): of each known artifact of changes (artifact_id, ...) the columns that changes has are now these, nulls too."""
        new = [c for c in changes.columns if c != "artifact_id"]
        asked = changes.select("artifact_id", F.struct(*new).alias("_new")).dropDuplicates(["artifact_id"])
        rest = [f.name for f in self.table.schema.fields if f.name != "artifact_id"]
        joined = self.table.get(asked)
        values = [F.col(f"_new.{c}").alias(c) if c in new else F.col(c) for c in rest]
        self.table.put(joined.where("found").select("artifact_id", *values))
        known = self.table.read().select("artifact_id").withColumn("found", F.lit(True))
        return asked.select("artifact_id").join(known, "artifact_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def delete(self, ids: DataFrame) -> DataFrame:
        """(artifact_id, found)."""
        return self.table.delete(ids)

    def review(self, ids: DataFrame) -> DataFrame:
        """(artifact_id, found): artifacts of ids (artifact_id, approved, notes) are reviewed."""
        return self.update(ids.select("artifact_id", F.lit(True).alias("reviewed"), F.coalesce("approved", F.lit(True)).alias("approved"), "notes"))


def queue(artifacts: DataFrame, pending_only: bool = True) -> DataFrame:
    """The artifacts with a priority by priority, highest first, then by id; only those not reviewed yet, or all."""
    rows = artifacts.where(F.col("priority").isNotNull())
    return (rows.where(~F.coalesce("reviewed", F.lit(False))) if pending_only else rows).orderBy(F.col("priority").desc(), "artifact_id")


def corrections(rows: DataFrame, artifact: int | None = None, engineer: str | None = None, field: str | None = None) -> DataFrame:
    """Corrections (artifact_id, engineer, field, ...) by what is stated; nothing stated leaves all."""
    for name, value in (("artifact_id", artifact), ("engineer", engineer), ("field", field)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def correction_counts(rows: DataFrame) -> DataFrame:
    """(kind, name, n): corrections by field, and on their own by engineer; nulls are a name."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in ("field", "engineer")]))
    return rows.select(each).groupBy("kind", "name").agg(F.count("*").alias("n"))
