"""Grounding, voting, merging of fields by confidence, review routing and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions import geometry

#: Confidence below which a component goes to review, and the limits of other rules.
LOW_CONFIDENCE, HIGH_VALUE_CONFIDENCE, AGREEMENT, CRITICAL_CONFIDENCE = 0.5, 0.8, 0.67, 0.9


def best_match(artifacts: DataFrame, detections: DataFrame) -> DataFrame:
    """Each artifact (image_id, artifact_id, box) with the detection (image_id, detection_id, box) of its image that overlaps it most; ties by id, none if nothing overlaps.

    Boxes meet within an image only, and the best is kept by a map-side maximum.
    """
    d = detections.select("image_id", "detection_id", F.col("box").alias("d_box"))
    pairs = artifacts.join(d, "image_id").withColumn("iou", geometry.iou(F.col("box"), F.col("d_box"))).where("iou > 0")
    best = pairs.groupBy("image_id", "artifact_id").agg(F.max(F.struct("iou", (-F.col("detection_id")).alias("minus"))).alias("b"))
    found = artifacts.select("image_id", "artifact_id").join(best, ["image_id", "artifact_id"], "left")
    return found.select("image_id", "artifact_id", (-F.col("b.minus")).alias("detection_id"), F.coalesce("b.iou", F.lit(0.0)).alias("iou"), F.col("b").isNotNull().alias("grounded"))


def grounding_score(matches: DataFrame) -> DataFrame:
    """The grounded share of each image's artifacts."""
    return matches.groupBy("image_id").agg(F.avg(F.col("grounded").cast("double")).alias("score"))


def majority_vote(votes: DataFrame) -> DataFrame:
    """(item_id, vote, pass) -> the vote most passes gave, ties to the one seen first, its share, and whether to review it."""
    each = votes.groupBy("item_id", "vote").agg(F.count("*").alias("n"), F.min("pass").alias("first"))
    all_of = each.groupBy("item_id").agg(F.max(F.struct("n", (-F.col("first")).alias("minus"), "vote")).alias("b"), F.sum("n").alias("total"))
    share = F.col("b.n") / F.col("total")
    return all_of.select("item_id", F.col("b.vote").alias("vote"), share.alias("agreement"), (share < AGREEMENT).alias("needs_review"))


def merge_fields(results: DataFrame) -> DataFrame:
    """M5 M6: (doc_id, field, tier, value, confidence, source) folded in order of tiers.

    A later value replaces the current one if there is none, its confidence is strictly higher, or it fills an empty one.
    """
    row = F.struct("tier", "value", "confidence", "source")
    tiers = results.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(row)).alias("tiers"))
    empty = lambda v: F.coalesce(v, F.lit("")) == ""
    better = lambda now, new: (new["confidence"] > now["confidence"]) | (empty(now["value"]) & ~empty(new["value"]))
    kept = F.aggregate(F.slice("tiers", F.lit(2), F.size("tiers")), F.element_at("tiers", 1), lambda now, new: F.when(better(now, new), new).otherwise(now))
    return tiers.select("doc_id", "field", kept.alias("k")).select("doc_id", "field", "k.value", "k.confidence", "k.source")


def overall(merged: DataFrame, critical: list[str]) -> DataFrame:
    """M7 M8: the least confidence of non-empty critical fields, 0 if there is none, and the review flag: one of them is empty or below 0.9."""
    is_critical = F.col("field").isin(critical)
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    good = is_critical & filled & (F.col("confidence") >= CRITICAL_CONFIDENCE)
    return merged.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(is_critical & filled, F.col("confidence"))), F.lit(0.0)).alias("overall_confidence"),
        (F.count_if(good) < len(critical)).alias("needs_review"),
    )


def weak_fields(merged: DataFrame, critical: list[str], least: float = 0.85, limit: int = 20) -> DataFrame:
    """Fields that are empty or below `least`, critical ones first, then by name, at most `limit` a document."""
    weak = merged.where((F.coalesce(F.col("value"), F.lit("")) == "") | (F.col("confidence") < least))
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("field").isin(critical), 0).otherwise(1), "field")
    return weak.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("doc_id", "field", "place")


def review_reasons(component: Column, confidence: Column, grounded: Column, flagged: Column, thresholds: dict[str, float], high_value: list[str]) -> Column:
    """Reasons to review an artifact; an earlier flag counts only if there is no other."""
    limit = F.lit(None).cast("double")
    for name, value in thresholds.items():
        limit = F.when(F.lower(component) == name, value).otherwise(limit)
    rules = (
        ("ungrounded", ~grounded),
        ("low_confidence", confidence < LOW_CONFIDENCE),
        ("component_threshold", F.coalesce(confidence < limit, F.lit(False))),
        ("high_value", F.lower(component).isin(high_value) & (confidence < HIGH_VALUE_CONFIDENCE)),
    )
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda r: r.isNotNull())
    return F.when(F.size(found) > 0, found).when(flagged, F.array(F.lit("previously_flagged"))).otherwise(found)


def review_priority(reasons: Column, confidence: Column) -> Column:
    """0.4 of the missing confidence, 0.2 each if ungrounded and of high value, 0.1 for each further reason up to three; at most 1."""
    has = lambda r: F.when(F.array_contains(reasons, r), 0.2).otherwise(0.0)
    more = F.least(F.greatest(F.size(reasons) - 1, F.lit(0)), F.lit(3)) * 0.1
    return F.least(F.lit(1.0), (1 - confidence) * 0.4 + has("ungrounded") + has("high_value") + more)


def merge_by_id(old: DataFrame, new: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Rows of old whose id new has not, and of each id in new the last by order_col."""
    last = Window.partitionBy(id_col).orderBy(F.col(order_col).desc())
    latest = new.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")
    return old.join(latest.select(id_col), id_col, "left_anti").unionByName(latest)
