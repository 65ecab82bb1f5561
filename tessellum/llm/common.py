"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.sources.tables import spread, table

SPACE = r"[\x20\x09-\x0D]+"
#: Spark SQL literal of the characters of SPACE, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, in as many partitions as there are cores, at least."""
    return spread(table(spark, sf_dir, "documents"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row: a lambda variable is bound, not copied into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; no other letter changes or gets another length."""
    return F.translate(text, UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from every column of df, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _with_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessellum-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a reliable checkpoint in the folder that the session names.

    A session on one machine without spark.checkpoint.dir, such as a test's, gets a folder of its own; on a cluster a
    missing setting is an error, as a machine's own folder would be lost with it. The folders go when their tables are
    no longer used, if the session sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    _with_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a table of 64-bit keys that is broadcast to filter by, some 64 MB; a larger one is joined by a shuffle.
FEW_KEYS = 2_000_000


def broadcastable(keys: DataFrame) -> DataFrame | None:
    """The checkpointed table of one column of longs, marked for a broadcast; None if it has more than FEW_KEYS rows."""
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else None


#: Rows of a table of heavy keys that is broadcast; a larger one is joined by a shuffle.
HEAVY = 10_000


def with_parts(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """rows with a column parts (long): into how many parts of `limit` rows their key's rows are to be dealt, 1 as a rule.

    The keys with more are at most a limit-th of the rows; as many as HEAVY are broadcast.
    """
    heavy = rows.groupBy(*keys).agg(F.count("*").alias("parts")).where(F.col("parts") > limit).withColumn("parts", F.ceil(F.col("parts") / limit))
    heavy = checkpointed(heavy)
    most = heavy.count()
    if not most:
        return rows.withColumn("parts", F.lit(1).cast("long"))
    return rows.join(F.broadcast(heavy) if most <= HEAVY else heavy, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below the one where checkpoints go, which every executor reaches; by the rules of checkpointed()."""
    return f"{_with_folder(spark)}/table-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that shared_folder() named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
