"""Readers and writers of records, manifests and exports; paths go to Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With a stated schema, so nothing is read twice; malformed lines are null rows."""
    return spark.read.schema(schema).json(path)


def write_index(index: DataFrame, path: str, *keys: str) -> None:
    """An index as Parquet, partitioned by keys."""
    index.write.mode("overwrite").partitionBy(*keys).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Header, quotes where they are needed and doubled inside, null as empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def header(rows: DataFrame, record: str, *order: str) -> list[str]:
    """The keys of the maps in column `record`, in the order in which they are first seen: by row, within a row by place.

    Each task sums up its keys, so only the header comes to the driver. Columns of order should tell rows apart.
    """
    seen = rows.select(F.struct(*order).alias("_row"), F.posexplode(F.map_keys(record)).alias("_place", "_key"))
    first = seen.groupBy("_key").agg(F.min(F.struct("_row", "_place")).alias("_first"))
    return [r[0] for r in first.orderBy("_first").select("_key").collect()]


def flattened(rows: DataFrame, record: str, *order: str) -> DataFrame:
    """A column for each key of header(), in that order; empty where a row does not have it or has null."""
    return rows.select(*[F.coalesce(F.try_element_at(F.col(record), F.lit(k)), F.lit("")).alias(k) for k in header(rows, record, *order)])


def export_json(rows: DataFrame, path: str, record: str) -> None:
    """One JSON object a line, with the record's members that are not null."""
    rows.select(F.to_json(F.map_filter(record, lambda k, v: v.isNotNull())).alias("value")).write.mode("overwrite").text(path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored index, None if there is none."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    return spark.read.parquet(path) if found else None


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) of the files under path; their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def content_hash(content: Column) -> Column:
    """S16."""
    return F.sha2(content, 256)


def inventory_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, state) of what differs between (path, size) tables: missing, extra or size."""
    r = remote.select(F.col("path").alias("r_path"), F.col("size").alias("r_size"))
    both = local.join(r, F.col("path") == F.col("r_path"), "full_outer")
    state = F.when(F.col("r_path").isNull(), "missing").when(F.col("path").isNull(), "extra").when(F.col("size") != F.col("r_size"), "size")
    return both.select(F.coalesce("path", "r_path").alias("path"), state.alias("state")).where("state is not null")
