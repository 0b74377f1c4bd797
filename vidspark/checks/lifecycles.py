"""Whole compositions over the given tables."""

from pyspark.sql import functions as F

from vidspark.checks.gates import reject
from vidspark.checks.registry import query
from vidspark.checks.vectors import RAW
from vidspark.checks.views import DOMAIN, table, view
from vidspark.checks.workflow import AS_OF, STATE, queue_rows
from vidspark.operators.common import rounded
from vidspark.params import VECTOR_IMAGE, MergeRules, TrackVote
from vidspark.plans.merging import merge_duplicates
from vidspark.plans.recognition import recognise_images as recognise
from vidspark.plans.training import collect_images, cycle_report
from vidspark.plans.training import training_queue as queue_plan
from vidspark.plans.video import analyse_videos

FACES = """faces AS (SELECT *, probe_id * 37 % 300 AS blur, probe_id * 11 % 140 AS contrast, probe_id * 17 % 256 AS brightness, probe_id * 5 % 60 AS edges, 0.5e0 + probe_id % 50 / 100.0e0 AS confidence, w_pct * h_pct AS area FROM probes)"""


@query("recognise_images", f"""WITH {FACES}, g AS (SELECT *, CASE WHEN confidence < 0.65e0 THEN 'low' ELSE {reject(VECTOR_IMAGE)} END AS r FROM faces), v AS (SELECT * FROM (SELECT *, max(area) OVER (PARTITION BY image_id) AS m FROM g WHERE r IS NULL) x WHERE area >= m * 0.3e0),
    q AS (SELECT v.image_id, 'person_' || a.person_id AS person, {RAW.format(a='v.embedding', b='a.embedding')} AS d, row_number() OVER (PARTITION BY v.probe_id ORDER BY {RAW.format(a='v.embedding', b='a.embedding')}, a.vec_id) AS rank FROM v JOIN gallery a ON a.domain = v.domain),
    p AS (SELECT image_id, person, round(min(d), 12) AS d FROM q WHERE rank <= 10 AND d <= 0.85e0 GROUP BY ALL),
    b AS (SELECT image_id, count(*) FILTER (d < 0.5) AS persons_matched, arg_min(person, struct_pack(d := d, p := person)) FILTER (d < 0.5) AS person, min(d) FILTER (d < 0.5) AS distance, arg_min(person, struct_pack(d := d, p := person)) FILTER (d >= 0.5) AS near_person, min(d) FILTER (d >= 0.5) AS near_distance FROM p GROUP BY 1),
    c AS (SELECT image_id, count(*) AS faces, count(r) AS rejected FROM g GROUP BY 1)
    SELECT image_id, faces, rejected, coalesce(persons_matched, 0) AS persons_matched, person, round(distance, 6) + 0.0 AS distance, near_person, round(near_distance, 6) AS near_distance FROM c LEFT JOIN b USING (image_id)""", ("gallery", "probes"))
def recognise_images(spark, sf):
    k = F.col("probe_id")
    faces = view(spark, sf, "probes").select("*", (k * 37 % 300).alias("blur"), (k * 11 % 140).alias("contrast"), (k * 17 % 256).alias("brightness"), (k * 5 % 60).alias("edges"), (0.5 + k % 50 / 100.0).alias("confidence"),
                                             F.lit("l").alias("left_eye"), F.lit("r").alias("right_eye"), (F.col("w_pct") * F.col("h_pct")).alias("area"))
    out = recognise(faces, view(spark, sf, "gallery"), view(spark, sf, "persons"), dim=64, threshold=0.5, near=1.7)
    return out.select("image_id", "faces", "rejected", "persons_matched", "person", rounded("distance", 6).alias("distance"), "near_person", F.round("near_distance", 6).alias("near_distance"))


def videos(spark, sf):
    d = view(spark, sf, "detections")
    vec = table(spark, sf, "embeddings").select("vec_id", F.expr(DOMAIN.format("label")).alias("domain"), "embedding")
    n = vec.count()
    d = d.withColumn("vec_id", F.col("vec_id") % n).join(vec, "vec_id")
    frames = d.groupBy("video_id", "frame_number").agg(F.count("*").alias("faces"))
    return analyse_videos(d, view(spark, sf, "gallery"), view(spark, sf, "persons"), frames, votes=TrackVote(min_ratio=0.3, min_consistency=0.2, min_best=50.0), frame_step=1)


@query("video_persons")
def video_persons(spark, sf):
    return videos(spark, sf).persons


@query("video_labels")
def video_labels(spark, sf):
    return videos(spark, sf).labels


@query("training_queue", f"""WITH {STATE}, due AS (SELECT * FROM state WHERE person NOT IN (SELECT person FROM queue_events WHERE action = 'purchase' AND floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400) < 7))
    SELECT person, priority, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, coalesce("order", 999999), added_at, person) AS position FROM due""", ("queue_events",))
def training_queue(spark, sf):
    history = view(spark, sf, "queue_events").filter("action = 'purchase'")
    return queue_plan(queue_rows(spark, sf), history, as_of=F.lit(AS_OF).cast("timestamp_ntz")).select("person", "priority", "position")


@query("training_collect", f"""WITH v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS grp, embedding FROM embeddings), pr AS (SELECT a.grp, a.id, b.id AS other, {RAW.format(a='a.embedding', b='b.embedding')} AS d FROM v a JOIN v b ON a.grp = b.grp),
    n AS (SELECT grp, id, count(*) AS n FROM pr WHERE d < 0.85 GROUP BY ALL), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, id) AS rn FROM n) x WHERE rn = 1 AND n >= 4),
    refs AS (SELECT p.grp, p.other AS id FROM best b JOIN pr p ON p.grp = b.grp AND p.id = b.id WHERE p.d < 0.85), j AS (SELECT p.grp, p.id, bool_or(p.d < 0.8) AS ok FROM pr p JOIN refs r ON r.grp = p.grp AND r.id = p.other GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS n, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j),
    t AS (SELECT *, CASE WHEN n <= 50 THEN 0 ELSE ceil((n - 50) / 30) END AS chunk FROM s WHERE n <= 170), dry AS (SELECT grp, min(chunk) AS dry FROM (SELECT grp, chunk FROM t GROUP BY ALL HAVING count(*) FILTER (ok) = 0) z GROUP BY 1)
    SELECT grp AS person_id, count(*) AS tried, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok) >= 7 AS success FROM t LEFT JOIN dry USING (grp) WHERE before < 12 AND (dry IS NULL OR chunk <= dry) GROUP BY 1""")
def training_collect(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("person_id"), "embedding")
    got = collect_images(v, v, person="person_id", consensus_threshold=0.85, accept_threshold=0.8, target=12)
    return cycle_report(got, person="person_id")


@query("merge_duplicates")
def merge_duplicates_query(spark, sf):
    people = view(spark, sf, "names").groupBy("name").agg(F.min("person_id").alias("person_id"))
    vectors = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("person_id"), "l_orderkey")
    persons, moved = merge_duplicates(people, vectors, types=("SPELLING_VARIANT",), rules=MergeRules(spelling=(("red", "blue"), ("small", "large")), typo_similarity=90.0, duplicate_similarity=95.0))
    return moved.groupBy("person_id").agg(F.count("*").alias("vectors")).join(persons, "person_id")
