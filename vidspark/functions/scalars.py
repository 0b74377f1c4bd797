"""Small numeric, date and nested-value rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, in order.
DATE_LAYOUTS = ("yyyy-M-d", "d-M-yyyy H:m:s", "d-M-yyyy", "d.M.yyyy H:m:s", "d.M.yyyy")


def dms_to_decimal(dms: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds (array<double>) to decimal degrees; south and west negative."""
    value = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60.0 + F.get(dms, F.lit(2)) / 3600.0
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def human_bytes(n: Column) -> Column:
    size = n.cast("double")
    out = F.when(size < 1024.0, F.format_string("%.2f B", F.bround(size, 2)))
    for power, unit in enumerate(("KB", "MB", "GB"), start=1):
        scaled = size / 1024.0**power
        out = out.when(scaled < 1024.0, F.format_string(f"%.2f {unit}", F.bround(scaled, 2)))
    return out.otherwise(F.format_string("%.2f TB", F.bround(size / 1024.0**4, 2)))


def parse_date(text: Column) -> Column:
    """First layout that parses; null (never the clock) where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_LAYOUTS])


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def days_since(as_of: Column, ts: Column) -> Column:
    return F.floor(seconds_between(as_of, ts) / 86400)


def hours_since(as_of: Column, ts: Column) -> Column:
    return seconds_between(as_of, ts) / 3600


def in_days(ts: Column, first: str, last: str, whole_last_second: bool = True) -> Column:
    """Inclusive day range. With `whole_last_second` off, the range ends at 23:59:59 sharp, which is
    how ISO strings compare; fractions of the last second then fall out."""
    t = ts.cast("timestamp_ntz")
    low = F.lit(f"{first} 00:00:00").cast("timestamp_ntz")
    if whole_last_second:
        return (t >= low) & (t < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    return (t >= low) & (t <= F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))


def statistics_of(result: Column) -> Column:
    """`statistics` of a stored result: under `face_recognition` in the newer layout, else at the root."""
    newer = result["face_recognition"]
    return F.when(newer.isNotNull(), newer["statistics"]).otherwise(result["statistics"])


def top_matches(result: Column) -> Column:
    """At most three {rank, person, confidence, occurrences, min_distance, weighted_score} out of four
    result layouts: detected list, best match + others, plain list, single person."""

    def number(c: Column, places: int) -> Column:
        return F.when(c != 0, F.round(c, places))

    def entry(rank: Column, person: Column, conf: Column, occ=None, dist=None, score=None) -> Column:
        none = F.lit(None)
        return F.struct(
            rank.cast("int").alias("rank"), person.alias("person"), number(conf, 2).alias("confidence"),
            (none.cast("long") if occ is None else occ).alias("occurrences"),
            (none.cast("double") if dist is None else number(dist, 4)).alias("min_distance"),
            (none.cast("double") if score is None else number(score, 4)).alias("weighted_score"),
        )

    def others(arr: Column, n: int, start: int) -> Column:
        made = F.transform(F.slice(arr, 1, n), lambda m, i: entry(i + start, F.coalesce(m["person"], m["name"]), m["confidence"]))
        return F.filter(F.coalesce(made, F.array().cast(_ENTRIES)), lambda e: F.coalesce(e["person"], F.lit("")) != "")

    detected = F.transform(
        F.slice(result["all_detected_matches"], 1, 3),
        lambda m, i: entry(
            i + 1, F.translate(m["person_name"], "_", " "), m["metrics"]["confidence_percentage"], m["metrics"]["occurrences"],
            m["metrics"]["min_distance"], m["metrics"]["weighted_score"],
        ),
    )
    b = result["best_match"]
    cm = b["confidence_metrics"]
    best_name = F.coalesce(b["display_name"], b["person"], b["name"])
    best = F.when(best_name.isNotNull(), F.array(entry(F.lit(1), best_name, F.when(cm.isNotNull(), cm["confidence_percentage"]).otherwise(b["confidence"]), cm["occurrences"], cm["min_distance"], cm["weighted_score"])))
    more = F.when(F.size(result["all_matches"]) > 0, result["all_matches"]).otherwise(result["top_matches"])
    with_best = F.concat(F.coalesce(best, F.array().cast(_ENTRIES)), others(more, 2, 2))
    single = F.when(F.coalesce(result["person"], F.lit("")) != "", F.array(entry(F.lit(1), result["person"], result["confidence"])))
    found = F.when(b.isNotNull(), with_best).when(result["matches"].isNotNull(), others(result["matches"], 3, 1))
    none = F.array().cast(_ENTRIES)
    return F.when(F.size(result["all_detected_matches"]) > 0, detected).otherwise(
        F.when(F.size(found) > 0, found).otherwise(F.coalesce(single, none))
    )


_ENTRIES = "array<struct<rank:int,person:string,confidence:double,occurrences:bigint,min_distance:double,weighted_score:double>>"
RESULT_SCHEMA = (
    "struct<all_detected_matches:array<struct<person_name:string,metrics:struct<confidence_percentage:double,occurrences:bigint,min_distance:double,weighted_score:double>>>,"
    "best_match:struct<display_name:string,person:string,name:string,confidence:double,confidence_metrics:struct<confidence_percentage:double,occurrences:bigint,min_distance:double,weighted_score:double>>,"
    "all_matches:array<struct<person:string,name:string,confidence:double>>,top_matches:array<struct<person:string,name:string,confidence:double>>,"
    "matches:array<struct<person:string,name:string,confidence:double>>,person:string,confidence:double>"
)
