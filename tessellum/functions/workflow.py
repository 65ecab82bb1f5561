"""Stages of a study: names, order, and moves between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stages in order and their labels; older names and what they are now.
STAGES = {
    "uploading_documents": "Uploading Documents",
    "analyzing_rooms": "Analyzing Rooms",
    "resource_extraction": "Resource Extraction",
    "reviewing_rooms": "Reviewing Rooms",
    "engineering_takeoff": "Engineering Takeoffs",
    "completed": "Completed",
}
OLDER = {
    "documents_uploaded": "uploading_documents",
    "first_analysis_pending": "analyzing_rooms",
    "first_analysis_complete": "resource_extraction",
    "first_review_complete": "engineering_takeoff",
    "takeoffs_pending": "engineering_takeoff",
    "takeoffs_complete": "engineering_takeoff",
    "takeoffs_review_complete": "engineering_takeoff",
    "analyzing_takeoffs": "engineering_takeoff",
    "reviewing_takeoffs": "engineering_takeoff",
    "reviewing_assets": "engineering_takeoff",
    "verification_pending": "engineering_takeoff",
    "verifying_assets": "engineering_takeoff",
}


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def place(stage: Column) -> Column:
    """Place of a stage from 0, -1 for other names and null."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage).cast("int"), F.lit(0)) - 1


def migrated(status: Column) -> Column:
    """The present name of a status; other names stay."""
    return F.coalesce(_lookup(OLDER, status), status)


def label(status: Column) -> Column:
    """The label of a status, itself if it has none."""
    return F.coalesce(_lookup(STAGES, migrated(status)), status)


def step(status: Column) -> Column:
    """Place of a status in its present name."""
    return place(migrated(status))


def reachable(target: Column, visited: Column, status: Column) -> Column:
    """The target was visited or is the stage after the status."""
    seen = F.coalesce(F.array_contains(visited, target), F.lit(False))
    return seen | ((place(target) >= 0) & (place(target) == place(status) + 1))


def valid_move(before: Column, after: Column) -> Column:
    """From one known stage to the next."""
    return (place(before) >= 0) & (place(after) == place(before) + 1)


def moved(status: Column, current: Column, visited: Column, target: Column) -> Column:
    """(status, current, visited, overall) after a move to target: the status only rises, the step follows, overall is pending, in_progress or completed."""
    current, visited = F.coalesce(current, status), F.coalesce(visited, F.array(status))
    rises = (place(target) >= place(current)) & (place(target) > place(status))
    new = F.when(rises, target).otherwise(status)
    seen = F.when(F.array_contains(visited, target), visited).otherwise(F.concat(visited, F.array(target)))
    overall = F.when(new == "completed", "completed").when(new == "uploading_documents", "pending").otherwise("in_progress")
    return F.struct(new.alias("status"), target.alias("current"), seen.alias("visited"), overall.alias("overall"))
