"""Ranking, scoring and near misses over the matches of whole images."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.vectors import PAIRS
from vidspark.checks.views import view
from vidspark.functions import vectors as V
from vidspark.operators import matching as M
from vidspark.operators.common import rounded
from vidspark.operators.search import knn_join, match_folds

# The 20 nearest within 0.95 of every probe, with the probe's image and box.
MATCHES = PAIRS + """, matches AS (SELECT *, probe_id * 100 + rank AS seq, round(d, 12) AS distance, 'person_' || person_id AS person FROM
    (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, vec_id) AS rank FROM pairs WHERE d < 0.95) x WHERE rank <= 20)"""
G = ("gallery", "probes")


def matches(spark, sf):
    probes = view(spark, sf, "probes")
    hits = knn_join(probes, view(spark, sf, "gallery"), k=20, threshold=0.95)
    boxes = probes.select("probe_id", "image_id", "x_pct", "y_pct", "w_pct", "h_pct")
    return hits.join(boxes, "probe_id").withColumn("seq", F.col("probe_id") * 100 + F.col("rank")).withColumn(
        "person", F.concat(F.lit("person_"), F.col("person_id")))


SCORE = """, s AS (SELECT image_id, person, distance, row_number() OVER (PARTITION BY image_id, person ORDER BY distance, seq) AS rn FROM {src} WHERE distance < {t}),
    a AS (SELECT image_id, person, count(*) AS occurrences, avg(distance) AS avg_distance, min(distance) AS min_distance, avg(distance) FILTER (rn <= 3) AS top3 FROM s GROUP BY ALL),
    b AS (SELECT image_id, person, arg_min(w_pct, seq) AS w, arg_min(h_pct, seq) AS h FROM {src} GROUP BY ALL),
    f AS (SELECT a.*, top3 * 0.5e0 + min_distance * 0.2e0 - occurrences * 0.05e0 - {bonus} AS score FROM a JOIN b USING (image_id, person))
    SELECT image_id, person, CAST(rank AS BIGINT) AS rank, occurrences, round(avg_distance, 4) + 0.0 AS avg_distance, round(min_distance, 4) + 0.0 AS min_distance, round(score, 4) + 0.0 AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score, person) AS rank FROM f) z WHERE rank <= 10"""


# Greedy grouping, one opener per image and round: the first position no opener so far covers.
GROUPED = """, spots AS (SELECT image_id, x_pct AS x, y_pct AS y, min(seq) AS f FROM matches GROUP BY ALL),
    open_(image_id, os) AS (SELECT image_id, [arg_min({'x': x, 'y': y}, f)] FROM spots GROUP BY 1
        UNION ALL SELECT o.image_id, list_append(any_value(o.os), arg_min({'x': s.x, 'y': s.y}, s.f)) FROM open_ o JOIN spots s ON s.image_id = o.image_id
            WHERE len(list_filter(o.os, lambda l: abs(l.x - s.x) <= 10 AND abs(l.y - s.y) <= 10)) = 0 GROUP BY o.image_id),
    last_ AS (SELECT image_id, arg_max(os, len(os)) AS os FROM open_ GROUP BY 1),
    grp AS (SELECT m.*, list_position(list_transform(os, lambda l: abs(l.x - m.x_pct) <= 10 AND abs(l.y - m.y_pct) <= 10), true) - 1 AS box_group FROM matches m JOIN last_ USING (image_id)),
    grouped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, box_group ORDER BY distance, seq) AS pick FROM grp) x WHERE pick = 1)"""


@query("box_groups", f"WITH RECURSIVE {MATCHES}{GROUPED} SELECT image_id, CAST(box_group AS BIGINT) AS box_group, person, seq, round(distance, 6) + 0.0 AS distance FROM grouped", G)
def box_groups(spark, sf):
    return M.group_boxes(matches(spark, sf)).select("image_id", "box_group", "person", "seq", rounded("distance", 6).alias("distance"))


@query("rank_per_probe", f"""WITH {MATCHES} SELECT probe_id, CAST(rank AS BIGINT) AS rank, vec_id FROM matches WHERE rank IN (1, 2, 3)""", G)
def rank_per_probe(spark, sf):
    return matches(spark, sf).filter(F.col("rank") <= 3).select("probe_id", F.col("rank").cast("long").alias("rank"), "vec_id")


@query("best_per_person", f"""WITH {MATCHES}, b AS (SELECT image_id, person, min(distance) AS distance FROM matches GROUP BY ALL)
    SELECT image_id, person, CAST(rank AS BIGINT) AS rank, round(distance, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY distance, person) AS rank FROM b) x WHERE rank <= 5""", G)
def best_per_person(spark, sf):
    out = M.best_per_person(matches(spark, sf), probe="image_id", person="person", top=5)
    return out.select("image_id", "person", F.col("rank").cast("long").alias("rank"), rounded("distance", 6).alias("distance"))


@query("near_misses", f"""WITH {MATCHES}, o AS (SELECT probe_id, person, min(distance) AS m, count(*) AS occurrences FROM matches WHERE vec_id <> probe_id GROUP BY ALL)
    SELECT probe_id, person, occurrences, round(m, 4) AS min_distance, round(m - 0.7e0, 4) AS above_threshold FROM o WHERE m >= 0.7e0 AND m <= 0.7e0 * 1.2e0""", G)
def near_misses(spark, sf):
    others = matches(spark, sf).filter(F.col("vec_id") != F.col("probe_id"))
    out = M.near_misses(others, image="probe_id", person="person", threshold=0.7)
    return out.select("probe_id", "person", "occurrences", F.round("min_distance", 4).alias("min_distance"), F.round("above_threshold", 4).alias("above_threshold"))


@query("best_of_image", f"""WITH {MATCHES} SELECT image_id, arg_min(vec_id, distance) AS vec_id, arg_min(person, distance) AS person, round(min(distance), 6) AS distance FROM matches WHERE vec_id <> probe_id GROUP BY image_id""", G)
def best_of_image(spark, sf):
    others = matches(spark, sf).filter(F.col("vec_id") != F.col("probe_id"))
    return M.best_of_image(others, image="image_id").select("image_id", "vec_id", "person", F.round("distance", 6).alias("distance"))


@query("distance_profile", f"""WITH {MATCHES} SELECT image_id, person, count(*) AS n, round(avg(distance), 4) + 0.0 AS avg_distance, round(min(distance), 4) + 0.0 AS min_distance, round(max(distance), 4) + 0.0 AS max_distance,
    round((1 - max(distance)) * 100, 3) + 0.0 AS min_confidence, round((1 - min(distance)) * 100, 3) + 0.0 AS max_confidence FROM matches GROUP BY image_id, person""", G)
def distance_profile(spark, sf):
    p = M.distance_profile(matches(spark, sf), keys=["image_id", "person"])
    return p.select("image_id", "person", "n", *[rounded(c, 4).alias(c) for c in ("avg_distance", "min_distance", "max_distance")], *[rounded(c, 3).alias(c) for c in ("min_confidence", "max_confidence")])


@query("threshold_sweep", f"""WITH {MATCHES}, t AS (SELECT CAST(unnest([0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]) AS DOUBLE) AS threshold), o AS (SELECT * FROM matches WHERE vec_id <> probe_id),
    c AS (SELECT image_id, threshold, count(*) FILTER (distance < threshold) AS matches FROM o CROSS JOIN t GROUP BY ALL)
    SELECT image_id, threshold, matches, min(threshold) FILTER (matches > 0) OVER (PARTITION BY image_id) AS first_threshold FROM c""", G)
def threshold_sweep(spark, sf):
    others = matches(spark, sf).filter(F.col("vec_id") != F.col("probe_id"))
    return M.threshold_sweep(others, keys=["image_id"], thresholds=[0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])


@query("result_overlap", f"""WITH {MATCHES}, m AS (SELECT image_id, person, min(distance) AS lo, count(*) AS n FROM matches WHERE vec_id <> probe_id GROUP BY ALL),
    a AS (SELECT image_id, person, row_number() OVER (PARTITION BY image_id ORDER BY lo, person) AS rank FROM m), b AS (SELECT image_id, person, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, person) AS rank FROM m),
    x AS (SELECT image_id, list(person) FILTER (rank <= 5) AS s, min(person) FILTER (rank = 1) AS top1 FROM a GROUP BY 1), y AS (SELECT image_id, list(person) FILTER (rank <= 5) AS s, min(person) FILTER (rank = 1) AS top1 FROM b GROUP BY 1)
    SELECT image_id, x.top1 AS a_top1, y.top1 AS b_top1, x.top1 = y.top1 AS top1_match, CAST(len(list_intersect(x.s, y.s)) AS BIGINT) AS overlap,
    round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) * 100, 2) AS overlap_pct FROM x JOIN y USING (image_id)""", G)
def result_overlap(spark, sf):
    from vidspark.operators.common import top_per_group

    m = matches(spark, sf).filter(F.col("vec_id") != F.col("probe_id")).groupBy("image_id", "person").agg(F.min("distance").alias("lo"), F.count("*").alias("n"))
    a = top_per_group(m, ["image_id"], [F.col("lo"), F.col("person")], 5)
    b = top_per_group(m, ["image_id"], [F.col("n").desc(), F.col("person")], 5)
    return M.result_overlap(a, b, on="image_id")


@query("boxes_in_valid_set", """WITH b AS (SELECT video_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h FROM detections GROUP BY ALL HAVING count(*) >= 2)
    SELECT d.video_id, d.det_id FROM detections d WHERE EXISTS (SELECT 1 FROM b WHERE b.video_id = d.video_id AND abs(b.x1 - d.x1) <= 2 AND abs(b.y1 - d.y1) <= 2 AND abs(b.w - (d.x2 - d.x1)) <= 2 AND abs(b.h - (d.y2 - d.y1)) <= 2)""", ("detections",))
def boxes_in_valid_set(spark, sf):
    d = view(spark, sf, "detections").select("video_id", "det_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    valid = d.groupBy("video_id", "x", "y", "w", "h").count().filter(F.col("count") >= 2)  # boxes seen at least twice
    return M.keep_in_valid_boxes(d, valid, on="video_id", tol=2.0).select("video_id", "det_id")


@query("ensemble_vote", f"""WITH {MATCHES}, v AS (SELECT probe_id, person, 'Facenet512' AS model, distance FROM matches UNION ALL SELECT probe_id, person, 'ArcFace', distance * 0.98e0 FROM matches WHERE vec_id <> probe_id),
    m AS (SELECT probe_id, person, model, min(distance) AS d FROM v WHERE distance < CASE model WHEN 'ArcFace' THEN 0.85e0 ELSE 0.8e0 END GROUP BY ALL),
    s AS (SELECT probe_id, person, count(*) AS models, sum(CASE model WHEN 'ArcFace' THEN 2.0e0 ELSE 1.0e0 END * (1 - d)) AS vote FROM m GROUP BY ALL HAVING count(*) >= 2)
    SELECT probe_id, person, models, round(vote, 5) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY vote DESC, person) AS rn FROM s) x WHERE rn = 1""", G)
def ensemble_vote(spark, sf):
    m = matches(spark, sf)
    votes = m.select("probe_id", "person", F.lit("Facenet512").alias("model"), "distance").unionByName(
        m.filter(F.col("vec_id") != F.col("probe_id")).select("probe_id", "person", F.lit("ArcFace").alias("model"), (F.col("distance") * 0.98).alias("distance")))
    out = M.ensemble_vote(votes, image="probe_id", person="person", model="model", distance="distance", thresholds={"Facenet512": 0.8, "ArcFace": 0.85}, weights={"ArcFace": 2.0})
    return out.select("probe_id", "person", "models", F.round("vote", 5).alias("vote"))


@query("box_scaling", """SELECT det_id, CAST(trunc(x1 * (1920.0e0 / 640.0e0)) AS BIGINT) AS x_orig, round(x1 / 640.0e0 * 100, 2) AS x_pct, greatest(0, CAST(x1 AS BIGINT) - 20) AS mx1, greatest(0, CAST(y1 AS BIGINT) - 20) AS my1,
    least(640, CAST(x1 AS BIGINT) + 120) AS mx2, least(480, CAST(y1 AS BIGINT) + 120) AS my2 FROM detections""", ("detections",))
def box_scaling(spark, sf):
    d = view(spark, sf, "detections")
    x, y = F.col("x1").cast("long"), F.col("y1").cast("long")
    w, h = (F.col("x2") - F.col("x1")).cast("long"), (F.col("y2") - F.col("y1")).cast("long")
    m = V.box_with_margin(x, y, w, h, F.lit(640).cast("long"), F.lit(480).cast("long"))
    return d.select("det_id", V.scale_int(F.col("x1"), F.lit(1920.0), F.lit(640.0)).alias("x_orig"), V.scale_percent(F.col("x1"), F.lit(640.0)).alias("x_pct"),
                    m["x1"].alias("mx1"), m["y1"].alias("my1"), m["x2"].alias("mx2"), m["y2"].alias("my2"))


@query("box_iou", """WITH i AS (SELECT a.det_id, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h FROM detections a JOIN detections b ON b.det_id = a.det_id + 1)
    SELECT det_id, round(CASE WHEN w <= 0 OR h <= 0 THEN 0.0 ELSE w * h / (20000 - w * h) END, 6) AS iou FROM i""", ("detections",))
def box_iou(spark, sf):
    d = view(spark, sf, "detections").select("det_id", F.struct("x1", "y1", "x2", "y2").alias("b"))
    m = d.join(d.select((F.col("det_id") - 1).alias("det_id"), F.col("b").alias("next")), "det_id")
    return m.select("det_id", F.round(V.iou(F.col("b"), F.col("next")), 6).alias("iou"))


@query("box_layouts", """SELECT det_id, CASE det_id % 6 WHEN 5 THEN 0.0 ELSE x1 END AS x1, CASE det_id % 6 WHEN 5 THEN 0.0 ELSE y1 END AS y1,
    CASE det_id % 6 WHEN 5 THEN 100.0 ELSE x2 END AS x2, CASE det_id % 6 WHEN 5 THEN 100.0 ELSE y2 END AS y2 FROM detections""", ("detections",))
def box_layouts(spark, sf):
    d = view(spark, sf, "detections")
    xywh = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    area, region = F.to_json(F.struct(xywh.alias("facial_area"))), F.to_json(F.struct(xywh.alias("region")))
    quad = F.to_json(F.struct(F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("facial_area")))
    bbox, flat = F.to_json(F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"))), F.to_json(F.struct("x1", "y1", "x2", "y2"))
    n = F.col("det_id") % 6
    payload = F.when(n == 0, area).when(n == 1, quad).when(n == 2, bbox).when(n == 3, flat).when(n == 4, region).otherwise(F.lit("{}"))
    return d.select("det_id", V.normalise_box(payload).alias("b")).select("det_id", "b.x1", "b.y1", "b.x2", "b.y2")


# Scoring, profile and sweep over every match, not the nearest 20.
EVERY = PAIRS + ", every AS (SELECT *, round(d, 12) AS distance FROM pairs WHERE round(d, 12) < 0.9)"
WITHIN = PAIRS + ", matches AS (SELECT *, probe_id AS seq, round(d, 12) AS distance, person_id AS person FROM pairs WHERE round(d, 12) < 0.95)"
LADDER = (0.3, 0.5, 0.7, 0.8, 0.85)


def folds(spark, sf, **blocks):
    return match_folds(view(spark, sf, "probes"), view(spark, sf, "gallery"), threshold=0.9, thresholds=LADDER, **blocks)


FOLDED = f"""WITH {EVERY}, s AS (SELECT *, row_number() OVER (PARTITION BY image_id, person_id ORDER BY distance) AS rn FROM every),
    a AS (SELECT image_id, person_id, count(*) AS occurrences, avg(distance) AS av, min(distance) AS mi, avg(distance) FILTER (rn <= 3) AS top3 FROM s GROUP BY ALL),
    f AS (SELECT *, round(top3 * 0.5e0 + mi * 0.2e0 - occurrences * 0.05e0, 10) AS score FROM a)
    SELECT image_id, person_id, occurrences, round(av, 4) + 0.0 AS avg_distance, round(mi, 4) + 0.0 AS min_distance, round(score, 4) + 0.0 AS score FROM f"""


def _folded(spark, sf, **blocks):
    out = M.folded_analysis(folds(spark, sf, **blocks), top=1 << 30)
    return out.select("image_id", "person_id", "occurrences", rounded("avg_distance", 4).alias("avg_distance"), rounded("min_distance", 4).alias("min_distance"), rounded(F.round("score", 10), 4).alias("score"))


@query("match_analysis_every", FOLDED, G)
def match_analysis_every(spark, sf):
    return _folded(spark, sf)


@query("match_analysis_every_in_blocks", FOLDED, G)
def match_analysis_every_in_blocks(spark, sf):
    return _folded(spark, sf, cells=8, broadcast_bytes=0, block_rows=64)


@query("distance_profile_every", f"WITH {EVERY} SELECT image_id, person_id, count(*) AS n, round(avg(distance), 6) + 0.0 AS avg_distance, round(min(distance), 6) + 0.0 AS min_distance, round(max(distance), 6) + 0.0 AS max_distance FROM every GROUP BY ALL", G)
def distance_profile_every(spark, sf):
    return folds(spark, sf).select("image_id", "person_id", "n", rounded(F.col("sum_distance") / F.col("n"), 6).alias("avg_distance"), rounded("min_distance", 6).alias("min_distance"), rounded("max_distance", 6).alias("max_distance"))


@query("threshold_sweep_every", f"WITH {EVERY} SELECT image_id, person_id, " + ", ".join(f"count(*) FILTER (distance < {t}) AS n_{i}" for i, t in enumerate(LADDER)) + " FROM every GROUP BY ALL", G)
def threshold_sweep_every(spark, sf):
    return folds(spark, sf).select("image_id", "person_id", *[f"n_{i}" for i in range(len(LADDER))])


def _ranked(df):
    return df.select("image_id", "person_id", F.col("rank").cast("long").alias("rank"), "occurrences", rounded("avg_distance", 4).alias("avg_distance"),
                     rounded("min_distance", 4).alias("min_distance"), rounded("score", 4).alias("score"))


SCORES = SCORE.replace("image_id, person, CAST(rank", "image_id, person AS person_id, CAST(rank").replace("AS score FROM a JOIN", "AS score0 FROM a JOIN").replace(
    "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score, person)", "SELECT *, round(score0, 10) AS score, row_number() OVER (PARTITION BY image_id ORDER BY round(score0, 10), person)")
BONUS = f"WITH {WITHIN}" + SCORES.format(src="matches", t="0.9", bonus="w * h / 100.0e0 * 0.15e0")
ALL = f"WITH {WITHIN}" + SCORES.format(src="matches", t="0.85", bonus="0.0")
BY_BOX = f"WITH RECURSIVE {WITHIN}{GROUPED}" + SCORES.format(src="grouped", t="0.95", bonus="w * h / 100.0e0 * 0.15e0")


@query("match_analysis_all", ALL, G)
def match_analysis_all(spark, sf):
    found = match_folds(view(spark, sf, "probes"), view(spark, sf, "gallery"), threshold=0.85)
    return _ranked(M.folded_analysis(found.filter("person_id IS NOT NULL")))


def _bonus(spark, sf, **blocks):
    found = match_folds(view(spark, sf, "probes"), view(spark, sf, "gallery"), threshold=0.9, within=0.95, first=("w_pct", "h_pct"), **blocks)
    return _ranked(M.folded_analysis(found.filter("person_id IS NOT NULL"), size_bonus=True))


@query("match_analysis_bonus", BONUS, G)
def match_analysis_bonus(spark, sf):
    """The box of the first matching probe of the image counts, whether that match is close or only a candidate."""
    return _bonus(spark, sf)


@query("match_analysis_bonus_in_blocks", BONUS, G)
def match_analysis_bonus_in_blocks(spark, sf):
    return _bonus(spark, sf, cells=8, broadcast_bytes=0, block_rows=64)


@query("match_analysis_grouped", BY_BOX, G)
def match_analysis_grouped(spark, sf):
    return _ranked(M.grouped_analysis(view(spark, sf, "probes"), view(spark, sf, "gallery"), threshold=0.95))


@query("match_analysis_grouped_in_blocks", BY_BOX, G)
def match_analysis_grouped_in_blocks(spark, sf):
    return _ranked(M.grouped_analysis(view(spark, sf, "probes"), view(spark, sf, "gallery"), threshold=0.95, cells=8, broadcast_bytes=0, block_rows=64))
