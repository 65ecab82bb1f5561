"""Results of agents as fields of their study: rows (id, field, value), value being JSON, for a table of studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_json(value: Column) -> Column:
    """Any value as JSON text, null members kept."""
    whole = F.to_json(F.struct(value.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(whole, 6, F.length(whole) - 6)


def fields(rows: DataFrame, id_col: str, values: dict[str, Column]) -> DataFrame:
    """A row for each of the values of each row."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), as_json(value).alias("value")) for name, value in values.items()])
    return rows.select(F.col(id_col).cast("string").alias("id"), F.inline(each))


def reviewed(rows: DataFrame) -> DataFrame:
    """Rows of results with needs_review false, confidence 0 and citations empty where they are not stated; a reason only where a review is needed."""
    known = set(rows.columns)
    review = F.coalesce(F.col("needs_review"), F.lit(False)) if "needs_review" in known else F.lit(False)
    out = rows.withColumn("needs_review", review)
    if "confidence" in known:
        out = out.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    if "citations" in known:
        out = out.withColumn("citations", F.coalesce("citations", F.array().cast(rows.schema["citations"].dataType)))
    if "review_reason" in known:
        out = out.withColumn("review_reason", F.when(F.col("needs_review"), F.col("review_reason")))
    return out


def summaries(rows: DataFrame, study: str, field: str, at: Column, **more: Column) -> DataFrame:
    """Field updates of each study: how many results it has and how many need a review, and aggregates by name.

    The results stay rows of their own table, keyed by study and result, so no study is gathered.
    """
    review = F.count_if(F.coalesce(F.col("needs_review"), F.lit(False)))
    found = rows.groupBy(study).agg(F.count("*").alias("total"), review.alias("needs_review"), *[c.alias(name) for name, c in more.items()])
    told = F.struct("total", "needs_review", *more, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("completed_at"))
    return fields(found, study, {field: told})


def with_evidence(rows: DataFrame, id_col: str, field: str, data: Column, version: str, at: Column) -> DataFrame:
    """The field, and beside it its metadata from the columns citations, confidence, needs_review and review_reason."""
    meta = F.struct(
        "citations", "confidence", "needs_review", "review_reason", F.lit(version).alias("agent_version"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    )
    return fields(rows, id_col, {field: data, f"{field}_metadata": meta})


def stage_complete(rows: DataFrame, id_col: str, stage: str, following: str, summary: Column, at: Column) -> DataFrame:
    """The stage's time and summary, and the next status."""
    return fields(rows, id_col, {f"{stage}_completed_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), f"{stage}_summary": summary, "workflowStatus": F.lit(following)})


def advanced(rows: DataFrame, id_col: str, status: Column) -> DataFrame:
    """The status alone."""
    return fields(rows, id_col, {"workflowStatus": status})


def uploaded(files: DataFrame, more: DataFrame, study: str, order: str) -> DataFrame:
    """The studies' files (study, place, ...) and after each study's last place those of more (study, order, ...), in order."""
    last = files.groupBy(study).agg(F.max("place").alias("_last"))
    place = F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy(study).orderBy(order))
    added = more.join(last, study, "left").withColumn("place", place.cast(files.schema["place"].dataType)).select(*files.columns)
    return files.unionByName(added)
