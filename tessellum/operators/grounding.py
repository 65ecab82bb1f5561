"""Artifacts checked against detections, built from them, and corrected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions import geometry, labels

#: Least overlap of a grounded box, confidence below which an artifact goes to review.
LEAST_IOU, LOW_CONFIDENCE = 0.5, 0.5


def _spatial(artifacts: DataFrame, detections: DataFrame) -> DataFrame:
    """Artifacts with b: (iou, label, confidence, id) of the detection of their image that overlaps most; ties by place, null if none does."""
    d = detections.select("image_id", "place", F.col("detection_id").alias("d_id"), F.col("label").alias("d_label"), F.col("confidence").alias("d_confidence"), F.col("box").alias("d_box"))
    pairs = artifacts.select("image_id", "artifact_id", "box").join(d, "image_id").withColumn("iou", geometry.iou(F.col("box"), F.col("d_box"))).where("iou > 0")
    best = pairs.groupBy("image_id", "artifact_id").agg(F.max(F.struct("iou", (-F.col("place")).alias("minus"), "d_id", "d_label", "d_confidence")).alias("b"))
    return artifacts.join(best, ["image_id", "artifact_id"], "left")


def verified(artifacts: DataFrame, detections: DataFrame, least_iou: float = LEAST_IOU, need_label: bool = True) -> DataFrame:
    """(image_id, artifact_id, detection_id, detection_label, iou, grounded, confidence) of artifacts (image_id, artifact_id, detection_id, component, box).

    An artifact is held against the detection (image_id, place, detection_id, label, confidence, box) that it names, at
    full overlap, else against the one that overlaps most; confidence is halved where the labels are not related, and
    0 without any. Artifact ids are unique within an image; of repeated detection ids the first by place counts.
    """
    first = detections.groupBy("image_id", "detection_id").agg(F.min_by(F.struct(F.col("label").alias("n_label"), F.col("confidence").alias("n_confidence")), "place").alias("n"))
    both = _spatial(artifacts, detections).join(first, ["image_id", "detection_id"], "left")
    named = F.col("n").isNotNull()
    label = F.when(named, F.col("n.n_label")).otherwise(F.col("b.d_label"))
    same = labels.related(F.col("component"), label)
    iou = F.when(named, 1.0).otherwise(F.coalesce("b.iou", F.lit(0.0)))
    grounded = F.when(named, True).otherwise(iou >= least_iou) & (same | F.lit(not need_label)) & (named | F.col("b").isNotNull())
    sure = F.when(named, F.col("n.n_confidence")).otherwise(F.col("b.d_confidence") * iou)
    confidence = F.coalesce(F.when(same, sure).otherwise(sure * 0.5), F.lit(0.0))
    return both.select(
        "image_id", "artifact_id", F.when(named, F.col("detection_id")).otherwise(F.col("b.d_id")).alias("detection_id"),
        label.alias("detection_label"), iou.alias("iou"), grounded.alias("grounded"), confidence.alias("confidence"),
    )


def verified_region(claims: DataFrame, detections: DataFrame, least_iou: float = LEAST_IOU, need_label: bool = True) -> DataFrame:
    """As verified, for components seen in a box (image_id, artifact_id, component, box): by overlap only, with the detection's whole confidence if grounded, else 0."""
    both = _spatial(claims, detections)
    same = labels.related(F.col("component"), F.col("b.d_label")) | F.lit(not need_label)
    grounded = F.coalesce((F.col("b.iou") >= least_iou) & same, F.lit(False))
    return both.select("image_id", "artifact_id", F.col("b.d_id").alias("detection_id"), F.coalesce("b.iou", F.lit(0.0)).alias("iou"), grounded.alias("grounded"), F.when(grounded, F.col("b.d_confidence")).otherwise(0.0).alias("confidence"))


def built(component: Column, label: Column, confidence: Column, error: Column) -> Column:
    """An artifact's (component, confidence, grounded, needs_review, reason) from its detection and component.

    Low confidence is a reason before missing grounding. With an error the detection's label stands for the component
    at half the confidence, grounded, and always goes to review.
    """
    same = labels.same_thing(label, component)
    low = confidence < LOW_CONFIDENCE
    reason = (
        F.when(error.isNotNull(), F.concat(F.lit("VLM classification failed: "), error))
        .when(low, F.concat(F.lit("Low confidence: "), F.format_number(confidence, 2)))
        .when(~same, F.concat(F.lit("VLM type '"), component, F.lit("' not grounded in detection '"), label, F.lit("'")))
    )
    return F.struct(
        F.when(error.isNotNull(), label).otherwise(component).alias("component"),
        F.when(error.isNotNull(), confidence * 0.5).otherwise(confidence).alias("confidence"),
        (error.isNotNull() | same).alias("grounded"),
        reason.isNotNull().alias("needs_review"),
        reason.alias("reason"),
    )


def corrected(artifacts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Artifacts (artifact_id, classification map, fields map) with corrections (artifact_id, correction_id, field, value) applied in order of id.

    `classification.x` sets x of the classification, any other field one of fields; of each field the last correction
    counts. Adds corrected and correction_id, the last one's. Corrections of unknown artifacts change nothing.
    """
    place = Window.partitionBy("artifact_id", "field").orderBy(F.desc("correction_id"))
    latest = corrections.withColumn("_place", F.row_number().over(place)).where("_place = 1")
    inner = F.col("field").rlike(r"^classification\.[^.]*$")
    pair = lambda name: F.struct(name.alias("k"), F.col("value").alias("v"))
    per = latest.groupBy("artifact_id").agg(
        F.map_from_entries(F.collect_list(F.when(inner, pair(F.substring_index("field", ".", -1))))).alias("_inner"),
        F.map_from_entries(F.collect_list(F.when(~inner, pair(F.col("field"))))).alias("_outer"),
        F.max("correction_id").alias("correction_id"),
    )
    over = lambda old, new: F.when(F.col(new).isNull(), F.col(old)).otherwise(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)).alias(old)
    found = artifacts.join(per, "artifact_id", "left")
    return found.select("artifact_id", over("classification", "_inner"), over("fields", "_outer"), F.col("correction_id").isNotNull().alias("corrected"), "correction_id")


def reviewed(artifacts: DataFrame, decisions: DataFrame, id_col: str = "artifact_id") -> DataFrame:
    """Artifacts with (reviewed, approved, notes) of the last decision (id, seq, approved, notes) on each."""
    last = decisions.groupBy(id_col).agg(F.max_by(F.struct("approved", "notes"), "seq").alias("_d"))
    return artifacts.join(last, id_col, "left").select(*artifacts.columns, F.col("_d").isNotNull().alias("reviewed"), F.col("_d.approved").alias("approved"), F.col("_d.notes").alias("notes"))
