"""Gates over frame metrics, faces and page contents."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import table, view
from vidspark.operators import gates as G
from vidspark.params import BLOCKLIST, FILE_VIDEO, GATE_PROFILES, VECTOR_IMAGE

QUALITY = "(least(100.0e0, blur / 5) * 0.4e0 + least(100.0e0, contrast * 2) * 0.25e0 + (100 - abs(brightness - 127) * (100.0e0 / 127)) * 0.15e0 + least(100.0e0, edges * 2) * 0.2e0)"


def reject(p):
    return f"CASE WHEN blur < {p.blur} THEN 'too_blurry' WHEN contrast < {p.contrast} THEN 'low_contrast' WHEN brightness < {p.brightness_low} OR brightness > {p.brightness_high} THEN 'poor_brightness' WHEN edges < {p.edges} THEN 'low_edge_density' END"


def _metrics():
    return F.col("blur"), F.col("contrast"), F.col("brightness"), F.col("edges")


@query("crop_gate", f"SELECT video_id, event_id, {reject(VECTOR_IMAGE)} AS vector_reason, {reject(FILE_VIDEO)} AS file_reason FROM frames", ("frames",))
def crop_gate(spark, sf):
    return view(spark, sf, "frames").select("video_id", "event_id", G.crop_reject(*_metrics(), VECTOR_IMAGE).alias("vector_reason"), G.crop_reject(*_metrics(), FILE_VIDEO).alias("file_reason"))


@query("profile_gates", "SELECT profile, coalesce(reason, 'passed') AS reason, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{p.name}' AS profile, CASE WHEN confidence / 110.0e0 < {p.detection_confidence}e0 THEN 'low_confidence' ELSE {reject(p)} END AS reason FROM frames" for p in GATE_PROFILES) + ") x GROUP BY ALL", ("frames",))
def profile_gates(spark, sf):
    f = view(spark, sf, "frames").withColumn("confidence", F.col("confidence") / 110.0)
    return G.profile_gates(f).groupBy("profile", F.coalesce("reject_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


@query("detection_gate", """SELECT event_id, CASE WHEN confidence / 110.0e0 < 0.65e0 THEN 'low_confidence' WHEN event_id % 9 = 4 THEN 'identical_eyes' END AS reason FROM frames""", ("frames",))
def detection_gate(spark, sf):
    left = F.struct((F.col("event_id") % 50).alias("x"), F.lit(10).alias("y"))
    right = F.struct((F.col("event_id") % 50 + F.when(F.col("event_id") % 9 == 4, 0).otherwise(12)).alias("x"), F.lit(10).alias("y"))
    return view(spark, sf, "frames").select("event_id", G.detection_reject(F.col("confidence") / 110.0, left, right).alias("reason"))


@query("relative_size", """SELECT video_id, event_id FROM (SELECT *, max(blur * contrast) OVER (PARTITION BY video_id) AS m FROM frames) x WHERE blur * contrast >= m * 0.3e0""", ("frames",))
def relative_size(spark, sf):
    f = view(spark, sf, "frames").withColumn("area", F.col("blur") * F.col("contrast"))
    return G.relative_size_filter(f, image="video_id", area="area", ratio=0.30).select("video_id", "event_id")


@query("frame_quality", f"""SELECT event_id, round({QUALITY}, 4) AS quality, {QUALITY} >= 50 AS is_good, CASE WHEN {QUALITY} < 40 THEN 'low_quality' END AS skipped_reason,
    round(CASE WHEN confidence > 85 AND {QUALITY} < 80 THEN confidence * (0.5e0 + {QUALITY} / 200.0e0) ELSE confidence END, 4) AS adjusted FROM frames""", ("frames",))
def frame_quality(spark, sf):
    f = view(spark, sf, "frames").withColumn("q", G.frame_quality(*_metrics()))
    return f.select("event_id", F.round("q", 4).alias("quality"), (F.col("q") >= 50).alias("is_good"), G.skip_reason(F.col("q")).alias("skipped_reason"),
                    F.round(G.penalised_confidence(F.col("confidence"), F.col("q")), 4).alias("adjusted"))


NAMED = "CASE event_type WHEN 'view' THEN 'Nikola Tesla' WHEN 'click' THEN 'Stevan_Stojanovic_Mokranjac' WHEN 'error' THEN 'Nikola_Tesla_Jr' ELSE event_type END"


@query("blocklist", f"SELECT label, count(*) AS n FROM (SELECT {NAMED} AS label FROM events) x WHERE replace(label, '_', ' ') NOT IN ('Nikola Tesla', 'Stevan Stojanovic Mokranjac') GROUP BY ALL")
def blocklist(spark, sf):
    e = table(spark, sf, "events").select(F.expr(NAMED).alias("label"))
    return G.remove_blocked(e, label="label", blocklist=BLOCKLIST).groupBy("label").agg(F.count("*").alias("n"))


def faces(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(F.floor(k / 3).alias("image_id"), k.alias("face_id"), (F.col("value") / 100.0).alias("confidence"), F.when(k % 8 != 5, k).alias("left_eye"), k.alias("right_eye"),
                    (k * 7 % 130).alias("w"), (k * 11 % 140).alias("h"), (k * 37 % 300).cast("double").alias("blur"))


FACES = """WITH faces AS (SELECT CAST(floor(event_id / 3) AS BIGINT) AS image_id, event_id AS face_id, value / 100.0e0 AS confidence, CASE WHEN event_id % 8 <> 5 THEN event_id END AS left_eye,
    event_id * 7 % 130 AS w, event_id * 11 % 140 AS h, event_id * 37 % 300 AS blur FROM events)"""


@query("face_count_class", FACES + """, c AS (SELECT image_id, count(*) FILTER (confidence > 0 AND left_eye IS NOT NULL AND w >= 20 AND h >= 20) AS real_faces,
    count(*) FILTER (confidence > 0 AND left_eye IS NOT NULL AND w >= 50 AND h >= 50) AS big FROM faces GROUP BY 1)
    SELECT image_id, real_faces, CASE WHEN real_faces = 1 AND big = 0 THEN -2 ELSE real_faces END AS face_class, real_faces = 1 AND big > 0 AS trainable FROM c""")
def face_count_class(spark, sf):
    return G.face_count_class(faces(spark, sf), image="image_id")


SUBJECT = FACES + """, m AS (SELECT *, CASE WHEN w < 70 OR h < 70 THEN 'too_small' WHEN blur < 40 THEN 'too_blurry' END AS r FROM faces),
    g AS (SELECT image_id, count(*) FILTER (r IS NULL) AS valid_faces, count(*) FILTER (r IS NOT NULL) AS invalid_faces, arg_min(r, face_id) FILTER (r IS NOT NULL) AS f FROM m GROUP BY 1)
    SELECT image_id, valid_faces, invalid_faces, CASE WHEN valid_faces > 1 THEN 'multiple_faces' WHEN valid_faces = 0 AND invalid_faces = 1 THEN f WHEN valid_faces = 0 THEN 'multiple_invalid' {strict} ELSE 'accepted' END AS decision FROM g"""


@query("single_subject", SUBJECT.format(strict=""))
def single_subject(spark, sf):
    return G.single_subject(faces(spark, sf), image="image_id", order="face_id")


@query("single_subject_strict", SUBJECT.format(strict="WHEN invalid_faces > 0 THEN 'multiple_faces'"))
def single_subject_strict(spark, sf):
    return G.single_subject(faces(spark, sf), image="image_id", order="face_id", strict=True)


@query("content_sniff", """WITH c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '\\xFF\\xD8\\xFF'::BLOB || encode(html) WHEN 1 THEN '\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB || encode(html) WHEN 2 THEN encode('GIF89a' || html) ELSE encode(html) END AS content, html FROM pages)
    SELECT page_id, CASE WHEN octet_length(content) < 1000 THEN 'too_small' WHEN page_id % 4 < 3 THEN 'image' WHEN html[1:1] = '<' THEN 'html' ELSE 'unknown' END AS verdict FROM c""")
def content_sniff(spark, sf):
    p = table(spark, sf, "pages")
    raw = F.encode("html", "UTF-8")
    n = F.col("page_id") % 4
    content = F.when(n == 0, F.concat(F.unhex(F.lit("FFD8FF")), raw)).when(n == 1, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), raw)).when(n == 2, F.encode(F.concat(F.lit("GIF89a"), "html"), "UTF-8")).otherwise(raw)
    return p.select("page_id", G.sniff_reason(content).alias("verdict"))


@query("staging_readiness", "SELECT video_id, count(*) AS images, count(*) FILTER (blur >= 100) AS ready_images, count(*) FILTER (blur >= 100) >= 60 AS is_ready FROM frames GROUP BY 1", ("frames",))
def staging_readiness(spark, sf):
    return G.staging_readiness(view(spark, sf, "frames"), key="video_id", ready=F.col("blur") >= 100, minimum=60)


@query("production_readiness", """WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') AS files, count(*) FILTER (l_tax > 0.07 AND l_discount > 0.05 AND l_linestatus = 'O' AND l_quantity > 20) AS vectors FROM lineitem GROUP BY 1)
    SELECT l_suppkey, files, vectors, CASE WHEN vectors >= 25 THEN 'ready' WHEN vectors > 0 AND vectors < 20 THEN 'insufficient' WHEN vectors = 0 THEN 'no_vectors' ELSE 'partial' END AS readiness FROM c WHERE files > 0 OR vectors > 0""")
def production_readiness(spark, sf):
    li = table(spark, sf, "lineitem")
    c = li.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("files"), F.count_if((F.col("l_tax") > 0.07) & (F.col("l_discount") > 0.05) & (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 20)).alias("vectors"))
    return G.production_readiness(c, files="files", vectors="vectors", ready_at=25)
