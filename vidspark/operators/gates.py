"""Detection and quality gates. Rows are labelled with the first reason that rejects them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.operators.common import parameter_table, with_group
from vidspark.params import GATE_PROFILES, GateProfile


def detection_reject(confidence: Column, left_eye: Column, right_eye: Column, minimum: float | Column = 0.65) -> Column:
    """Low detector confidence, or both eyes at the same place; null where the detection passes."""
    return F.when(F.coalesce(confidence, F.lit(1.0)) < minimum, "low_confidence").when(
        left_eye == right_eye, "identical_eyes"
    )


def crop_reject(blur: Column, contrast: Column, brightness: Column, edges: Column, limits: GateProfile | Column) -> Column:
    """Crop quality, tested in fixed order; null where the crop passes. `limits` may be a struct
    column, so that several profiles are judged in one pass."""
    if isinstance(limits, GateProfile):
        limits = profile_struct(limits)
    return (
        F.when(blur < limits["blur"], "too_blurry")
        .when(contrast < limits["contrast"], "low_contrast")
        .when((brightness < limits["brightness_low"]) | (brightness > limits["brightness_high"]), "poor_brightness")
        .when(edges < limits["edges"], "low_edge_density")
    )


def profile_struct(p: GateProfile) -> Column:
    fields = ("name", "blur", "edges", "contrast", "brightness_low", "brightness_high", "detection_confidence", "match_threshold")
    return F.struct(*[F.lit(getattr(p, f)).alias(f) for f in fields])


def profile_gates(crops: DataFrame, profiles: Sequence[GateProfile] = GATE_PROFILES) -> DataFrame:
    """Every crop under every named profile: a fixed, short list exploded per row, no join."""
    each = crops.withColumn("profile", F.explode(F.array(*[profile_struct(p) for p in profiles])))
    limits = F.col("profile")
    reason = F.coalesce(
        F.when(F.col("confidence") < limits["detection_confidence"], "low_confidence"),
        crop_reject(F.col("blur"), F.col("contrast"), F.col("brightness"), F.col("edges"), limits),
    )
    return each.withColumn("reject_reason", reason).withColumn("profile", F.col("profile.name"))


def relative_size_filter(df: DataFrame, *, image: str, area: str, ratio: float = 0.30) -> DataFrame:
    """Keep boxes of at least `ratio` of the largest box of their image."""
    return with_group(df, [image], F.max(area).alias("_max")).filter(F.col(area) >= F.col("_max") * ratio).drop("_max")


def frame_quality(blur: Column, contrast: Column, brightness: Column, edges: Column) -> Column:
    """0-100: sharpness 40 %, contrast 25 %, brightness near mid-grey 15 %, edges 20 %."""
    hundred = F.lit(100.0)
    return (
        F.least(hundred, blur / 5) * 0.4
        + F.least(hundred, contrast * 2) * 0.25
        + (100 - F.abs(brightness - 127) * (100 / 127)) * 0.15
        + F.least(hundred, edges * 2) * 0.20
    )


def skip_reason(quality: Column, minimum: float = 40.0) -> Column:
    return F.when(quality < minimum, "low_quality")


def penalised_confidence(raw: Column, quality: Column) -> Column:
    """High confidence on a poor frame is scaled down."""
    return F.when((raw > 85.0) & (quality < 80), raw * (0.5 + quality / 200.0)).otherwise(raw)


def canonical_label(label: Column) -> Column:
    return F.translate(label, "_", " ")


def remove_blocked(df: DataFrame, *, label: str, blocklist: Sequence[str]) -> DataFrame:
    """Drop blocked labels, underscore and space being the same."""
    blocked = parameter_table(df.sparkSession, [(b.replace("_", " "),) for b in blocklist], "_blocked string")
    return df.join(blocked, canonical_label(F.col(label)) == blocked["_blocked"], "left_anti")


def face_count_class(faces: DataFrame, *, image: str) -> DataFrame:
    """Real faces per image (confident, both eyes, 20 px or more); -2 where the only one is below 50 px."""
    real = (F.col("confidence") > 0) & F.col("left_eye").isNotNull() & F.col("right_eye").isNotNull() & (F.col("w") >= 20) & (F.col("h") >= 20)
    large = real & (F.col("w") >= 50) & (F.col("h") >= 50)
    counts = faces.groupBy(image).agg(F.count_if(real).alias("real_faces"), F.count_if(large).alias("_large"))
    cls = F.when((F.col("real_faces") == 1) & (F.col("_large") == 0), F.lit(-2).cast("long")).otherwise(F.col("real_faces"))
    return counts.withColumn("face_class", cls).withColumn("trainable", cls == 1).drop("_large")


def single_subject(faces: DataFrame, *, image: str, order: str, strict: bool = False, min_px: int = 70, min_blur: float = 40.0) -> DataFrame:
    """One decision per image: 'accepted', or the reason against it."""
    reason = F.when((F.col("w") < min_px) | (F.col("h") < min_px), "too_small").when(F.col("blur") < min_blur, "too_blurry")
    has_face = F.col("w").isNotNull()
    marked = faces.withColumn("_reason", reason)
    g = marked.groupBy(image).agg(
        F.count_if(has_face & F.col("_reason").isNull()).alias("valid_faces"),
        F.count_if(has_face & F.col("_reason").isNotNull()).alias("invalid_faces"),
        F.min_by(F.when(has_face, F.col("_reason")), F.when(has_face & F.col("_reason").isNotNull(), F.col(order))).alias("_first"),
    )
    valid, invalid = F.col("valid_faces"), F.col("invalid_faces")
    decision = F.when(valid > 1, "multiple_faces").when((valid == 0) & (invalid == 0), "no_face")
    decision = decision.when((valid == 0) & (invalid == 1), F.col("_first")).when(valid == 0, "multiple_invalid")
    if strict:
        decision = decision.when(invalid > 0, "multiple_faces")
    return g.withColumn("decision", decision.otherwise("accepted")).drop("_first")


def looks_like_image(content: Column) -> Column:
    """At least 1000 bytes and a JPEG, PNG, WebP or GIF signature."""

    def head(start: int, n: int) -> Column:
        return F.hex(F.substring(content, start, n))

    webp = (head(1, 4) == "52494646") & (F.octet_length(content) > 12) & (head(9, 4) == "57454250")
    magic = (head(1, 3) == "FFD8FF") | (head(1, 8) == "89504E470D0A1A0A") | webp | head(1, 6).isin("474946383761", "474946383961")
    return (F.octet_length(content) >= 1000) & magic


def sniff_reason(content: Column) -> Column:
    start = F.substring(content, 1, 1)
    return F.when(F.octet_length(content) < 1000, "too_small").when(looks_like_image(content), "image").when(
        F.hex(start) == "3C", "html"
    ).otherwise("unknown")


def staging_readiness(rows: DataFrame, *, key: str, ready: Column, minimum: int = 5) -> DataFrame:
    """Images per key and whether there are enough to be moved on."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("images"), F.count_if(ready).alias("ready_images")).withColumn(
        "is_ready", F.col("ready_images") >= minimum
    )


def production_readiness(counts: DataFrame, *, files: str, vectors: str, ready_at: int = 50, low: int = 20) -> DataFrame:
    """ready (>= 50 vectors), insufficient (1..19), partial between; orphans (no file, no vector) dropped."""
    v = F.col(vectors)
    kept = counts.filter((F.col(files) > 0) | (v > 0))
    return kept.withColumn("readiness", F.when(v >= ready_at, "ready").when((v > 0) & (v < low), "insufficient").when(v == 0, "no_vectors").otherwise("partial"))
