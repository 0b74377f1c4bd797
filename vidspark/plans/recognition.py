"""From detected faces of many images to one decision per image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.functions.vectors import confidence_pct, valid_vector
from vidspark.operators.gates import crop_reject, detection_reject, relative_size_filter
from vidspark.operators.search import match_folds
from vidspark.params import VECTOR_IMAGE, GateProfile


def gate_faces(faces: DataFrame, *, dim: int, profile: GateProfile = VECTOR_IMAGE) -> DataFrame:
    """Every face with the first reason that rejects it; null where it may be searched."""
    reason = F.coalesce(
        F.when(~valid_vector(F.col("embedding"), dim), "wrong_dimension"),
        detection_reject(F.col("confidence"), F.col("left_eye"), F.col("right_eye"), profile.detection_confidence),
        crop_reject(F.col("blur"), F.col("contrast"), F.col("brightness"), F.col("edges"), profile),
    )
    return faces.withColumn("reject_reason", reason)


def recognise_images(faces: DataFrame, gallery: DataFrame, persons: DataFrame, *, dim: int, threshold: float = 0.45, near: float = 1.4, profile: GateProfile = VECTOR_IMAGE, min_share: float = 0.30, **blocks) -> DataFrame:
    """Gates, size filter, one search at the widest cutoff over every gallery row, folded per image and person
    inside the block kernel, then per image the best match below the
    threshold and the nearest person missed by no more than the `near` factor. Gates are Column
    expressions below the search, so they reach the scan."""
    gated = gate_faces(faces, dim=dim, profile=profile)
    valid = relative_size_filter(gated.filter("reject_reason IS NULL"), image="image_id", area="area", ratio=min_share)
    hits = match_folds(valid, gallery, threshold=threshold * near, lowest=1, **blocks)
    hits = hits.join(persons.select("person_id", F.col("name").alias("person")), "person_id")
    per = hits.groupBy("image_id", "person").agg(F.min("min_distance").alias("distance"))
    hit, miss = F.col("distance") < threshold, F.col("distance") >= threshold
    key = F.struct("distance", "person")
    best = per.groupBy("image_id").agg(
        F.min(F.when(hit, key)).alias("_b"), F.min(F.when(miss, key)).alias("_n"), F.count_if(hit).alias("persons_matched"),
    )
    counts = gated.groupBy("image_id").agg(F.count(F.lit(1)).alias("faces"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
    return counts.join(best, "image_id", "left").select(
        "image_id", "faces", "rejected", F.coalesce("persons_matched", F.lit(0)).alias("persons_matched"), F.col("_b.person").alias("person"), F.col("_b.distance").alias("distance"),
        confidence_pct(F.col("_b.distance")).alias("confidence_pct"), F.col("_n.person").alias("near_person"), F.col("_n.distance").alias("near_distance"),
    )
