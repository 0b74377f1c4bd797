"""Voting over the frames of a video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.operators.common import numbered, runs, with_group
from vidspark.operators.gates import canonical_label
from vidspark.params import FrameVote


def dynamic_minimum(total_frames: Column, low: int = 5, high: int = 15, share: float = 0.03) -> Column:
    """Frames a label needs in a video of that length."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(total_frames * F.lit(share)))).cast("long")


def temporal_clusters(frames: DataFrame, *, keys: Sequence[str], frame: str = "frame_number", max_gap: int = 50, min_size: int = 3, min_share: float = 0.6) -> DataFrame:
    """Per key: rows in runs of at least `min_size`, their share, and whether the key is clustered."""
    found = runs(frames, keys, frame, max_gap=max_gap)
    big = F.col("n") >= min_size
    return found.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count_if(big).alias("clusters"), F.coalesce(F.sum(F.when(big, F.col("n"))), F.lit(0)).alias("rows_in_clusters")
    ).withColumn("is_clustered", (F.col("clusters") > 0) & (F.col("rows_in_clusters") / F.col("rows") >= min_share))


def frame_totals(frames: DataFrame, *, video: str) -> DataFrame:
    return frames.groupBy(video).agg(F.count(F.lit(1)).alias("total_frames"), F.count_if(F.col("recognized") & F.col("person").isNotNull()).alias("recognized_frames"))


def vote_frames(frames: DataFrame, *, video: str = "video_id", params: FrameVote = FrameVote()) -> DataFrame:
    """One row per (video, person): statistics, whether the person is confirmed, who is primary.

    The rows are read once into partial sums per (video, person), from which the video totals
    follow; the frames themselves stay in their table (`person_frames`)."""
    seen = F.col("recognized") & F.col("person").isNotNull()
    c = F.coalesce(F.col("confidence"), F.lit(0.0))
    per = frames.withColumn("person", F.when(seen, F.col("person"))).groupBy(video, "person").agg(
        F.count(F.lit(1)).alias("frame_count"), F.avg(c).alias("_avg"), F.max(c).alias("_best"), F.stddev_pop(c).alias("_std"),
        F.avg("occurrences").alias("_occ"), F.sum("occurrences").alias("total_training_matches"), F.sum(c * c).alias("_sq"),
        F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"),
    )
    totals = per.groupBy(video).agg(F.sum("frame_count").alias("total_frames"))
    clusters = temporal_clusters(
        frames.filter(seen), keys=[video, "person"], max_gap=params.max_gap, min_size=params.min_run, min_share=params.min_share
    ).select(video, "person", "is_clustered")

    n = F.col("frame_count")
    raw_score = F.col("_sq") / 100.0 if params.weighted else n * 100.0
    equivalent = F.col("_sq") / 10000.0 if params.weighted else n.cast("double")
    minimum = F.lit(params.min_occurrence).cast("long") if params.min_occurrence is not None else dynamic_minimum(F.col("total_frames"))
    blocked = F.array(*[F.lit(b.replace("_", " ")) for b in params.blocklist]).cast("array<string>")
    stats = (
        per.filter(F.col("person").isNotNull()).join(totals, video).join(clusters, [video, "person"], "left")
        .withColumn("occurrence_rate", F.round(n / F.col("total_frames") * 100, 2))
        .withColumn("avg_confidence", F.round("_avg", 2))
        .withColumn("best_confidence", F.round("_best", 2))
        .withColumn("confidence_std", F.round("_std", 2))
        .withColumn("avg_occurrences", F.round("_occ", 1))
        .withColumn("weighted_score", F.round(raw_score, 2))
        .withColumn("weighted_frame_equivalent", F.round(equivalent, 2))
        .withColumn("min_occurrence", minimum)
        .withColumn("passes_minimum", n >= F.col("min_occurrence"))
        .withColumn("is_blocked", F.array_contains(blocked, canonical_label(F.col("person"))))
    )
    order = ["weighted_score"] if params.weighted else ["frame_count", "avg_confidence"]
    standing, reach, blocked_out = F.struct(*order), F.col("passes_minimum"), F.col("is_blocked")
    tops = stats.groupBy(video).agg(
        F.max(F.when(reach, standing)).alias("_top"), F.max(F.when(reach & ~blocked_out, standing)).alias("_open")
    )
    stats = stats.join(tops, video)
    # ties on the score: the name decides, lowest first
    primary = with_group(
        stats, [video], F.min(F.when(reach & ~blocked_out & (standing == F.col("_open")), F.col("person"))).alias("primary_person")
    )
    top_score = F.col("_top.weighted_score") if params.weighted else F.col("_top.frame_count") * 100.0
    score_ok = (F.col("weighted_score") >= top_score * params.relative_score) | (F.col("weighted_score") >= params.absolute_score)
    std_ok = F.lit(True) if params.strict_reference else F.col("_std") <= params.max_std
    confirmed = reach & score_ok & (F.col("best_confidence") >= params.best_confidence) & std_ok & F.coalesce("is_clustered", F.lit(False))
    return primary.withColumn("confirmed", confirmed & ~blocked_out).withColumn(
        "is_primary", F.coalesce(F.col("person") == F.col("primary_person"), F.lit(False))
    ).drop("_avg", "_best", "_std", "_occ", "_sq", "_top", "_open", "primary_person")


def person_frames(frames: DataFrame, *, video: str = "video_id") -> DataFrame:
    """The frame list of every (video, person), as rows."""
    return frames.filter(F.col("recognized") & F.col("person").isNotNull()).select(video, "person", "frame_number", "frame_time")


def best_frames(frames: DataFrame, *, video: str, score: str, id: str, share: float = 0.5, minimum: int = 3) -> DataFrame:
    """The better half of the frames of each video, but at least `minimum`."""
    ranked = numbered(frames.withColumn("_neg", -F.col(score)), [video], ["_neg", id], name="rank")
    sized = with_group(ranked, [video], F.max("rank").alias("_n"))
    return sized.filter(F.col("rank") <= F.greatest(F.lit(minimum), F.floor(F.col("_n") * share))).drop("_neg", "_n")


def quality_distribution(frames: DataFrame, *, video: str, quality: str, minimum: float = 40.0) -> DataFrame:
    q = F.col(quality)
    return frames.groupBy(video).agg(
        F.round(F.avg(q), 2).alias("avg_quality"), F.round(F.min(q), 2).alias("min_quality"), F.round(F.max(q), 2).alias("max_quality"),
        F.count_if(q >= minimum).alias("above"), F.count_if(q < minimum).alias("below"), F.countDistinct("person").alias("persons"),
        F.approx_count_distinct("person").alias("persons_approx"),
    )


def sample_frames(frames: DataFrame, *, fps: float, interval: float, frame: str = "frame_number") -> DataFrame:
    """Frames a sampler with that interval would take, with their time. The interval is 0.1 to 60 s."""
    if not 0.1 <= interval <= 60:
        raise ValueError("interval must be between 0.1 and 60 seconds")
    step = max(1, int(fps * interval))
    return frames.filter(F.col(frame) % step == 0).withColumn("timestamp", F.col(frame) / F.lit(float(fps)))


def correlate_sources(confirmed: DataFrame, analyses: DataFrame, *, video: str, fields: Sequence[str]) -> DataFrame:
    """Confirmed labels against names found by another analysis, whose lists sit in up to five
    optional array columns: full outer join on the canonical name."""
    empty = F.array().cast("array<string>")
    listed = analyses.select(video, F.explode(F.concat(*[F.coalesce(F.col(f), empty) for f in fields])).alias("analysis_name"))

    right = listed.groupBy(video, _canonical("analysis_name").alias("name")).agg(F.count(F.lit(1)).alias("mentions"))
    left = confirmed.withColumn("name", _canonical("person"))
    return left.join(right, [video, "name"], "full_outer").withColumn(
        "found_in", F.when(F.col("person").isNull(), "analysis").when(F.col("mentions").isNull(), "vectors").otherwise("both")
    )


def _canonical(c: str) -> Column:
    return F.lower(F.trim(canonical_label(F.col(c))))


#: What an analysis tells of a person; missing fields are null.
PERSON_FIELDS = ("person_id", "identified_name", "name_source", "role", "physical_description")


def confirmed_or_voted(tracked: DataFrame, voted: DataFrame, *, video: str) -> DataFrame:
    """Confirmed persons of each video with total_frames, avg_confidence, total_tracks and `method`: those of
    the tracker (`tracked`: person, total_frames, avg_confidence, total_tracks), or, for a video in which it
    confirmed nobody, those of the frame vote (`voted`: person, frame_count, avg_confidence), as one track each."""
    by_tracks = tracked.select(video, "person", F.col("total_frames").cast("long").alias("total_frames"), "avg_confidence", F.coalesce(F.col("total_tracks").cast("long"), F.lit(1).cast("long")).alias("total_tracks"), F.lit("tracks").alias("method"))
    by_votes = voted.join(by_tracks.select(video).distinct(), video, "left_anti").select(video, "person", F.col("frame_count").cast("long").alias("total_frames"), "avg_confidence", F.lit(1).cast("long").alias("total_tracks"), F.lit("votes").alias("method"))
    return by_tracks.unionByName(by_votes)


def analysed_people(analyses: DataFrame, *, video: str, fields: Sequence[str]) -> DataFrame:
    """One row per person that an analysis lists, with `PERSON_FIELDS`. `fields`: the array-of-struct columns
    that may hold people; columns a table lacks, null lists and fields a struct lacks count as empty."""
    out = None
    for name in fields:
        if name not in analyses.columns:
            continue
        people = analyses.select(video, F.explode(name).alias("_p"))
        has = set(people.schema["_p"].dataType.fieldNames())
        rows = people.filter("_p is not null").select(video, *[(F.col(f"_p.{f}") if f in has else F.lit(None)).cast("string").alias(f) for f in PERSON_FIELDS])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"none of {list(fields)} is a column of the analyses")
    return out


def correlate_people(confirmed: DataFrame, people: DataFrame, *, video: str) -> DataFrame:
    """`people` (of `analysed_people`) beside `confirmed` (of `confirmed_or_voted`) by canonical name: one row
    per listed person, and one per confirmed person that nobody lists. Lists are never gathered: a hot video is
    split like any hot join key. A person without a name meets nobody; an empty name is none."""
    named = F.when(_canonical("identified_name") != "", _canonical("identified_name"))
    joined = confirmed.withColumn("name", _canonical("person")).join(people.withColumn("name", named).withColumn("_listed", F.lit(True)), [video, "name"], "full_outer")
    return joined.withColumn("found_in", F.when(F.col("person").isNull(), "analysis").when(F.col("_listed").isNull(), "vectors").otherwise("both")).drop("_listed")


def correlation_summary(confirmed: DataFrame, people: DataFrame, analyses: DataFrame, *, video: str) -> DataFrame:
    """Per video of either side: whether it was analysed, people listed, people listed with a name, persons
    confirmed, and how many canonical names both sides share."""
    def marked(df: DataFrame, kind: str, name: Column) -> DataFrame:
        return df.select(video, F.lit(kind).alias("_kind"), name.alias("_name"))

    null = F.lit(None).cast("string")
    rows = marked(analyses, "video", null).unionByName(marked(people, "person", F.when(_canonical("identified_name") != "", _canonical("identified_name")))).unionByName(marked(confirmed, "confirmed", _canonical("person")))
    # by name first, so that a name listed a million times is one row afterwards
    kind = F.col("_kind")
    names = rows.groupBy(video, "_name").agg(*[F.count_if(kind == k).alias(f"_{k}") for k in ("video", "person", "confirmed")])
    has_name = F.col("_name").isNotNull()
    return names.groupBy(video).agg(
        (F.sum("_video") > 0).alias("analysed"), F.sum("_person").alias("people_listed"), F.coalesce(F.sum(F.when(has_name, F.col("_person"))), F.lit(0)).alias("people_named"),
        F.sum("_confirmed").alias("persons_confirmed"), F.count_if(has_name & (F.col("_person") > 0) & (F.col("_confirmed") > 0)).alias("names_shared"),
    )


def rolling_means(frames: DataFrame, *, video: str, order: Sequence[str], values: Sequence[str], last: int, block: int = 100_000) -> DataFrame:
    """`frames` with rolling_<value>: the mean over a row and the `last` - 1 rows before it in its video, nulls
    left out; fewer rows at the start. `order` must be unique within a video (equal rows may swap).

    A video of any length is many tasks: rows are numbered by range, cut into blocks of `block` rows, and the
    last rows of a block also stand, as a halo, in front of the next one."""
    if last < 1:
        raise ValueError("last must be at least 1")
    block = max(block, last)
    rn = F.col("_at") - 1
    own = F.floor(rn / block)
    ranked = numbered(frames, [video], order, name="_at")
    # the halo: rows whose successors in the next block still look back at them
    copies = F.when(rn % block > block - last, F.array(own, own + 1)).otherwise(F.array(own))
    rows = ranked.withColumn("_own", own).withColumn("_block", F.explode(copies))
    w = W.partitionBy(video, "_block").orderBy("_at").rowsBetween(1 - last, 0)
    for v in values:
        rows = rows.withColumn(f"rolling_{v}", F.avg(v).over(w))
    return rows.filter(F.col("_block") == F.col("_own")).drop("_at", "_own", "_block")
