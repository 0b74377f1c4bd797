"""SQL registration: session functions without Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vidspark.functions.names import LATIN_FROM, LATIN_LONG, LATIN_TO, SPELLED_OUT

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


def register_functions(spark: SparkSession) -> None:
    """cosine_distance(a, b), iou(x1, y1, x2, y2, x1, y1, x2, y2), safe_name(s) for spark.sql."""
    ab, aa, bb = (_DOT.format(a=x, b=y) for x, y in (("a", "b"), ("a", "a"), ("b", "b")))
    scale = f"(sqrt({aa}) * sqrt({bb}))"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE "
        f"RETURN CASE WHEN {scale} = 0 THEN 1D ELSE 1D - {ab} / {scale} END"
    )
    w, h = "(least(ax2, bx2) - greatest(ax1, bx1))", "(least(ay2, by2) - greatest(ay1, by1))"
    union = f"((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - {w} * {h})"
    args = ", ".join(f"{s}{c} DOUBLE" for s in "ab" for c in ("x1", "y1", "x2", "y2"))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION iou({args}) RETURNS DOUBLE "
        f"RETURN CASE WHEN {w} <= 0 OR {h} <= 0 OR {union} <= 0 THEN 0D ELSE {w} * {h} / {union} END"
    )
    text = "s"
    for a, b in (*SPELLED_OUT, *LATIN_LONG):
        text = f"replace({text}, '{a}', '{b}')"
    folded = f"regexp_replace(translate({text}, '{LATIN_FROM}', '{LATIN_TO}'), '[^\\\\x00-\\\\x7F]', '')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION safe_name(s STRING) RETURNS STRING "
        f"RETURN regexp_replace(translate({folded}, ' ', '_'), '[^A-Za-z0-9_-]', '')"
    )
