"""From ranked matches to a decision per image: grouping by box, scoring by person, near misses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.operators.common import parameter_table, pct, spread, top_per_group


def group_boxes(
    matches: DataFrame, *, image: str = "image_id", x: str = "x_pct", y: str = "y_pct", order: str = "seq",
    distance: str = "distance", tol: float = 10.0,
) -> DataFrame:
    """Keep the closest match of every box group.

    In input order a box opens a group unless it lies within `tol` of the opener of an earlier one.
    All matches at one position share a fate, so positions are aggregated before the shuffle; what is
    left runs through a sorted scan that remembers only the openers of the current image (their
    number is bounded by the image area over tol squared). Matches without a box stand alone.
    """
    rest = [c for c in matches.columns if c not in (image, x, y)]
    placed = matches.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    spots = placed.groupBy(image, x, y).agg(
        F.min(order).alias("_first"), F.min_by(F.struct(*rest), F.struct(distance, order)).alias("_best")
    ).select(image, x, y, "_first", *[F.col(f"_best.{c}").alias(c) for c in rest])
    laid = spread(spots, image).sortWithinPartitions(image, "_first")

    def openers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # openers by grid cell of width tol: those within reach stand in the cell or next to it
        current, cells, opened = None, {}, 0
        for b in batches:
            group = np.empty(len(b), dtype=np.int64)
            for i, (im, px, py) in enumerate(zip(b[image], b[x].tolist(), b[y].tolist())):
                if im != current:
                    current, cells, opened = im, {}, 0
                cx, cy = (int(px // tol), int(py // tol)) if tol > 0 else (px, py)
                near = [n for dx in (-1, 0, 1) for dy in (-1, 0, 1) for n, ox, oy in cells.get((cx + dx, cy + dy), ()) if abs(ox - px) <= tol and abs(oy - py) <= tol]
                if near:
                    group[i] = min(near)
                else:
                    cells.setdefault((cx, cy), []).append((opened, px, py))
                    group[i] = opened
                    opened += 1
            yield b.assign(box_group=group)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema) + ", box_group long"
    grouped = laid.mapInPandas(openers, schema)
    kept = [c for c in grouped.columns if c not in (image, "box_group", "_first")]
    best = grouped.groupBy(image, "box_group").agg(F.min_by(F.struct(*kept), F.struct(distance, order)).alias("_b"))
    best = best.select(image, *[F.col(f"_b.{c}").alias(c) for c in kept], "box_group")
    alone = matches.filter(F.col(x).isNull() | F.col(y).isNull()).withColumn("box_group", F.lit(None).cast("long"))
    return best.unionByName(alone)


def match_analysis(
    matches: DataFrame, *, image: str = "image_id", person: str = "person", threshold: float = 0.40,
    size_bonus: bool = False, top: int = 10, distance: str = "distance", order: str = "seq",
) -> DataFrame:
    """Score of every person per image over the matches closer than `threshold`; lowest is best.

    0.5 * mean of the best three + 0.2 * minimum - 0.05 * count - bonus for a large first box.
    """
    d = F.col(distance)
    close = matches.filter(d < threshold)
    stats = close.groupBy(image, person).agg(
        F.count(F.lit(1)).alias("occurrences"), F.avg(d).alias("avg_distance"), F.min(d).alias("min_distance")
    )
    top3 = top_per_group(close.select(image, person, distance, order), [image, person], [d, F.col(order)], 3)
    stats = stats.join(top3.groupBy(image, person).agg(F.avg(d).alias("top3_distance")), [image, person])
    bonus = F.lit(0.0)
    if size_bonus:
        first = matches.filter(F.col("w_pct").isNotNull()).groupBy(image, person).agg(F.min_by(F.struct("w_pct", "h_pct"), F.col(order)).alias("_box"))
        stats = stats.join(first, [image, person], "left")
        bonus = F.coalesce(F.col("_box.w_pct") * F.col("_box.h_pct") / 100.0 * 0.15, F.lit(0.0))
    score = F.col("top3_distance") * 0.5 + F.col("min_distance") * 0.2 - F.col("occurrences") * 0.05 - bonus
    scored = stats.withColumn("size_bonus", bonus).withColumn("score", score).drop("_box")
    return top_per_group(scored, [image], [F.col("score"), F.col(person)], top)


def folded_analysis(folds: DataFrame, *, image: str = "image_id", person: str = "person_id", size_bonus: bool = False, top: int = 10) -> DataFrame:
    """The score of `match_analysis` over the folds of all matches (with `first=("w_pct", "h_pct")` for the
    size bonus)."""
    bonus = F.coalesce(F.col("w_pct") * F.col("h_pct") / 100.0 * 0.15, F.lit(0.0)) if size_bonus else F.lit(0.0)
    mean3 = F.aggregate("lowest", F.lit(0.0), lambda a, x: a + x) / F.size("lowest")
    score = mean3 * 0.5 + F.col("min_distance") * 0.2 - F.col("n") * 0.05 - bonus
    scored = folds.select(image, person, F.col("n").alias("occurrences"), (F.col("sum_distance") / F.col("n")).alias("avg_distance"), "min_distance", bonus.alias("size_bonus"), score.alias("score"))
    return top_per_group(scored, [image], [F.col("score"), F.col(person)], top)


def grouped_analysis(
    probes: DataFrame, gallery: DataFrame, *, image: str = "image_id", person: str = "person_id", threshold: float = 0.40, within: float | None = None,
    tol: float = 10.0, size_bonus: bool = True, top: int = 10, part: str = "domain", probe_id: str = "probe_id", gallery_id: str = "vec_id", **blocks,
) -> DataFrame:
    """Scores over all matches closer than `within`, one match per box group: the closest. A group keeps one
    match, and the closest of a box is its nearest gallery row, so the search returns one row per probe and
    leaves none out; boxes take part in the order of their ids. `probes` hold x_pct, y_pct, w_pct, h_pct."""
    from vidspark.operators.search import knn_join

    hits = knn_join(probes, gallery, k=1, threshold=max(threshold, within or 0.0), part=part, probe_id=probe_id, gallery_id=gallery_id, carry=(person,), **blocks)
    boxed = hits.drop("rank").join(probes.select(probe_id, image, "x_pct", "y_pct", "w_pct", "h_pct"), probe_id)
    grouped = group_boxes(boxed, image=image, order=probe_id, tol=tol)
    return match_analysis(grouped, image=image, person=person, threshold=threshold, size_bonus=size_bonus, top=top, order=probe_id)


def best_per_person(matches: DataFrame, *, probe: str, person: str, top: int, distance: str = "distance") -> DataFrame:
    """Closest distance per person, then the `top` persons of each probe."""
    best = matches.groupBy(probe, person).agg(F.min(distance).alias(distance))
    return top_per_group(best, [probe], [F.col(distance), F.col(person)], top)


def near_misses(matches: DataFrame, *, image: str, person: str, threshold: float, band: float = 1.2, distance: str = "distance") -> DataFrame:
    """Persons whose best distance misses the threshold by no more than the band factor."""
    best = matches.groupBy(image, person).agg(F.min(distance).alias("min_distance"), F.count(F.lit(1)).alias("occurrences"))
    return best.filter(F.col("min_distance").between(threshold, threshold * band)).withColumn(
        "above_threshold", F.col("min_distance") - threshold
    )


def best_of_image(matches: DataFrame, *, image: str, distance: str = "distance", tie: str = "vec_id") -> DataFrame:
    rest = [c for c in matches.columns if c != image]
    return matches.groupBy(image).agg(F.min_by(F.struct(*rest), F.struct(distance, tie)).alias("_b")).select(
        image, *[F.col(f"_b.{c}").alias(c) for c in rest]
    )


def distance_profile(matches: DataFrame, *, keys: Sequence[str], distance: str = "distance") -> DataFrame:
    d = F.col(distance)
    return matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("avg_distance"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"),
        ((1 - F.max(d)) * 100).alias("min_confidence"), ((1 - F.min(d)) * 100).alias("max_confidence"),
    )


def threshold_sweep(matches: DataFrame, *, keys: Sequence[str], thresholds: Sequence[float], distance: str = "distance") -> DataFrame:
    """Matches under each threshold, in one pass, and the first threshold that yields any."""
    counts = [F.count_if(F.col(distance) < t).alias(f"n_{i}") for i, t in enumerate(thresholds)]
    wide = matches.groupBy(*keys).agg(*counts)
    first = F.coalesce(*[F.when(F.col(f"n_{i}") > 0, F.lit(t)) for i, t in enumerate(thresholds)])
    entry = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n_{i}").alias("matches")) for i, t in enumerate(thresholds)])
    return wide.select(*keys, first.alias("first_threshold"), F.inline(entry))


def result_overlap(a: DataFrame, b: DataFrame, *, on: str, person: str = "person", rank: str = "rank", top: int = 5) -> DataFrame:
    """Agreement of two ranked lists: Jaccard of the top names and equality of the first ones."""

    def tops(df: DataFrame, side: str) -> DataFrame:
        return df.filter(F.col(rank) <= top).groupBy(on).agg(
            F.collect_set(person).alias(f"{side}_set"), F.min_by(person, rank).alias(f"{side}_top1")
        )

    both = tops(a, "a").join(tops(b, "b"), on, "full_outer")
    empty = F.array().cast("array<string>")
    sa, sb = F.coalesce("a_set", empty), F.coalesce("b_set", empty)
    inter, union = F.size(F.array_intersect(sa, sb)), F.size(F.array_union(sa, sb))
    return both.select(
        on, "a_top1", "b_top1", F.expr("a_top1 <=> b_top1").alias("top1_match"),
        inter.cast("long").alias("overlap"), F.coalesce(pct(inter, union), F.lit(0.0)).alias("overlap_pct"),
    )


def keep_in_valid_boxes(matches: DataFrame, boxes: DataFrame, *, on: str, tol: float = 5.0, box: Sequence[str] = ("x", "y", "w", "h")) -> DataFrame:
    """Matches whose box equals a valid box of the same image within `tol` on all four sides.

    Valid boxes are spread over a grid of cell size `tol`, so the join is an equi join on
    (image, cell) and a crowded image does not multiply its rows.
    """
    x, y, w, h = box

    def cell(c: Column) -> Column:
        return F.floor(c / tol)

    near = F.sequence(F.lit(-1), F.lit(1))
    valid = (
        boxes.select(on, *[F.col(c).alias(f"_{c}") for c in box]).distinct()
        .withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
        .withColumn("_cx", cell(F.col(f"_{x}")) + F.col("_dx")).withColumn("_cy", cell(F.col(f"_{y}")) + F.col("_dy"))
    )
    left = matches.withColumn("_cx", cell(F.col(x))).withColumn("_cy", cell(F.col(y)))
    cond = [left[on] == valid[on], left["_cx"] == valid["_cx"], left["_cy"] == valid["_cy"]]
    cond += [F.abs(left[c] - valid[f"_{c}"]) <= tol for c in box]
    return left.join(valid, cond, "left_semi").drop("_cx", "_cy")


def ensemble_vote(votes: DataFrame, *, image: str, person: str, model: str, distance: str, thresholds: dict[str, float], weights: dict[str, float] | None = None, min_models: int = 2) -> DataFrame:
    """Weighted vote over several models: each model counts its matches under its own threshold;
    a person needs `min_models` models and the highest weight wins."""
    weights = weights or {}
    rows = [(m, t, weights.get(m, 1.0)) for m, t in thresholds.items()]
    params = parameter_table(votes.sparkSession, rows, f"{model} string, _t double, _w double")
    passing = votes.join(params, model).filter(F.col(distance) < F.col("_t"))
    per_model = passing.groupBy(image, person, model).agg(F.min(distance).alias("_d"), F.first("_w").alias("_w"))
    scored = per_model.groupBy(image, person).agg(
        F.count(F.lit(1)).alias("models"), F.sum(F.col("_w") * (1 - F.col("_d"))).alias("vote")
    ).filter(F.col("models") >= min_models)
    return top_per_group(scored, [image], [F.col("vote").desc(), F.col(person)], 1).drop("rank")
