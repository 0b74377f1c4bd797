"""Frame voting, temporal clusters, frame selection."""

from pyspark.sql import functions as F

from vidspark.checks.gates import QUALITY
from vidspark.checks.registry import query
from vidspark.checks.views import table, view
from vidspark.operators import frames as FR
from vidspark.operators import gates as G
from vidspark.operators.common import runs
from vidspark.params import FrameVote

RUNS = """r AS (SELECT *, sum(o) OVER (PARTITION BY video_id, person ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT video_id, person, frame_number,
    CASE WHEN frame_number - lag(frame_number) OVER (PARTITION BY video_id, person ORDER BY frame_number) <= {gap} THEN 0 ELSE 1 END AS o FROM frames WHERE recognized) x)"""
CLUSTERED = RUNS.format(gap=50) + """, k AS (SELECT video_id, person, run, count(*) AS n FROM r GROUP BY ALL),
    cl AS (SELECT video_id, person, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n >= 3) AS clusters, CAST(coalesce(sum(n) FILTER (n >= 3), 0) AS BIGINT) AS rows_in_clusters FROM k GROUP BY ALL),
    clustered AS (SELECT *, clusters > 0 AND rows_in_clusters / rows >= 0.6e0 AS is_clustered FROM cl)"""


@query("temporal_clusters", f"WITH {CLUSTERED} SELECT * FROM clustered", ("frames",))
def temporal_clusters(spark, sf):
    return FR.temporal_clusters(view(spark, sf, "frames").filter("recognized"), keys=["video_id", "person"])


@query("presence_runs", f"WITH {RUNS.format(gap=20)} SELECT video_id, person, min(frame_number) AS run_start, max(frame_number) AS run_end, count(*) AS n, count(DISTINCT frame_number) AS n_positions FROM r GROUP BY video_id, person, run", ("frames",))
def presence_runs(spark, sf):
    return runs(view(spark, sf, "frames").filter("recognized"), ["video_id", "person"], "frame_number", max_gap=20, block=100)


VOTE = f"""WITH {CLUSTERED}, t AS (SELECT video_id, count(*) AS total_frames FROM frames GROUP BY 1),
    p AS (SELECT video_id, person, count(*) AS frame_count, avg(confidence) AS a, max(confidence) AS b, stddev_pop(confidence) AS sd, avg(occurrences) AS occ, CAST(sum(occurrences) AS BIGINT) AS total_training_matches,
        sum(confidence * confidence) AS sq, min(frame_number) AS first_frame, max(frame_number) AS last_frame FROM frames WHERE recognized GROUP BY ALL),
    s AS (SELECT p.*, total_frames, is_clustered, round({{score}}, 2) AS weighted_score, round({{equiv}}, 2) AS weighted_frame_equivalent, round(a, 2) AS avg_confidence, round(b, 2) AS best_confidence,
        greatest(5, least(15, CAST(floor(total_frames * CAST(0.03 AS DOUBLE)) AS BIGINT))) AS min_occurrence, person IN {{blocked}} AS is_blocked FROM p JOIN t USING (video_id) LEFT JOIN clustered USING (video_id, person)),
    m AS (SELECT *, frame_count >= min_occurrence AS passes_minimum FROM s),
    w AS (SELECT *, max(weighted_score) FILTER (passes_minimum) OVER (PARTITION BY video_id) AS top,
        row_number() OVER (PARTITION BY video_id ORDER BY passes_minimum AND NOT is_blocked DESC, {{order}}, person) AS rn FROM m)
    SELECT video_id, person, frame_count, total_training_matches, first_frame, last_frame, total_frames, is_clustered, round(frame_count / total_frames * 100, 2) AS occurrence_rate, avg_confidence, best_confidence, round(sd, 2) AS confidence_std,
        round(occ, 1) AS avg_occurrences, weighted_score, weighted_frame_equivalent, min_occurrence, passes_minimum, is_blocked,
        coalesce(passes_minimum AND (weighted_score >= top * 0.1e0 OR weighted_score >= 50) AND best_confidence >= 75 AND {{std}} AND is_clustered, false) AND NOT is_blocked AS confirmed,
        rn = 1 AND passes_minimum AND NOT is_blocked AS is_primary FROM w"""


@query("vote_frames", VOTE.format(score="sq / 100", equiv="sq / 10000", blocked="('none')", order="weighted_score DESC", std="sd <= 20"), ("frames",))
def vote_frames(spark, sf):
    return FR.vote_frames(view(spark, sf, "frames"))


@query("vote_frames_blocked", VOTE.format(score="sq / 100", equiv="sq / 10000", blocked="('click', 'view')", order="weighted_score DESC", std="true"), ("frames",))
def vote_frames_blocked(spark, sf):
    return FR.vote_frames(view(spark, sf, "frames"), params=FrameVote(blocklist=("click", "view"), strict_reference=True))


@query("vote_frames_by_count", VOTE.format(score="frame_count * 100.0e0", equiv="CAST(frame_count AS DOUBLE)", blocked="('none')", order="frame_count DESC, avg_confidence DESC", std="sd <= 20"), ("frames",))
def vote_frames_by_count(spark, sf):
    return FR.vote_frames(view(spark, sf, "frames"), params=FrameVote(weighted=False))


@query("person_frames", "SELECT video_id, person, frame_number, round(frame_time, 4) AS frame_time FROM frames WHERE recognized", ("frames",))
def person_frames(spark, sf):
    return FR.person_frames(view(spark, sf, "frames")).select("video_id", "person", "frame_number", F.round("frame_time", 4).alias("frame_time"))


@query("dynamic_minimum", "WITH t AS (SELECT video_id, count(*) AS total_frames FROM frames GROUP BY 1) SELECT video_id, total_frames, greatest(5, least(15, CAST(floor(total_frames * CAST(0.03 AS DOUBLE)) AS BIGINT))) AS minimum FROM t", ("frames",))
def dynamic_minimum(spark, sf):
    t = FR.frame_totals(view(spark, sf, "frames"), video="video_id")
    return t.select("video_id", "total_frames", FR.dynamic_minimum(F.col("total_frames")).alias("minimum"))


@query("best_frames", f"""SELECT video_id, event_id, rn AS rank FROM (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY round({QUALITY}, 9) DESC, event_id) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM frames) x
    WHERE rn <= greatest(3, floor(n * 0.5e0))""", ("frames",))
def best_frames(spark, sf):
    f = view(spark, sf, "frames").withColumn("q", F.round(G.frame_quality(F.col("blur"), F.col("contrast"), F.col("brightness"), F.col("edges")), 9))
    return FR.best_frames(f.select("video_id", "event_id", "q"), video="video_id", score="q", id="event_id").select("video_id", "event_id", "rank")


@query("quality_distribution", f"""SELECT video_id, round(avg(q), 2) AS avg_quality, round(min(q), 2) AS min_quality, round(max(q), 2) AS max_quality, count(*) FILTER (q >= 40) AS above, count(*) FILTER (q < 40) AS below, count(DISTINCT person) AS persons, true AS approx_ok
    FROM (SELECT *, {QUALITY} AS q FROM frames) x GROUP BY 1""", ("frames",))
def quality_distribution(spark, sf):
    f = view(spark, sf, "frames").withColumn("q", G.frame_quality(F.col("blur"), F.col("contrast"), F.col("brightness"), F.col("edges")))
    d = FR.quality_distribution(f, video="video_id", quality="q")
    return d.withColumn("approx_ok", F.abs(F.col("persons_approx") - F.col("persons")) <= F.col("persons") * 0.1).drop("persons_approx")


@query("sampled_frames", "SELECT video_id, event_id, frame_number, round(frame_number / 25.0e0, 6) AS timestamp FROM frames WHERE frame_number % 75 = 0", ("frames",))
def sampled_frames(spark, sf):
    s = FR.sample_frames(view(spark, sf, "frames"), fps=25.0, interval=3.0)
    return s.select("video_id", "event_id", "frame_number", F.round("timestamp", 6).alias("timestamp"))


@query("correlate_sources", """WITH conf AS (SELECT DISTINCT o_custkey % 50 AS video_id, 'Ana_P' || (o_custkey % 7) AS person FROM orders),
    lists AS (SELECT o_custkey % 50 AS video_id, ['ana p' || (o_custkey % 11)] AS a, CASE WHEN o_orderstatus = 'O' THEN ['Ana P' || (o_custkey % 3), 'Iva K'] END AS b FROM orders),
    n AS (SELECT video_id, lower(trim(replace(unnest(list_concat(coalesce(a, []), coalesce(b, []))), '_', ' '))) AS name FROM lists), r AS (SELECT video_id, name, count(*) AS mentions FROM n GROUP BY ALL)
    SELECT video_id, name, person, mentions, CASE WHEN person IS NULL THEN 'analysis' WHEN mentions IS NULL THEN 'vectors' ELSE 'both' END AS found_in FROM (SELECT *, lower(replace(person, '_', ' ')) AS name FROM conf) c FULL OUTER JOIN r USING (video_id, name)""")
def correlate_sources(spark, sf):
    o = table(spark, sf, "orders")
    vid = (F.col("o_custkey") % 50).alias("video_id")
    conf = o.select(vid, F.concat(F.lit("Ana_P"), F.col("o_custkey") % 7).alias("person")).distinct()
    lists = o.select(vid, F.array(F.concat(F.lit("ana p"), F.col("o_custkey") % 11)).alias("speakers"),
                     F.when(F.col("o_orderstatus") == "O", F.array(F.concat(F.lit("Ana P"), F.col("o_custkey") % 3), F.lit("Iva K"))).alias("people"))
    return FR.correlate_sources(conf, lists, video="video_id", fields=["speakers", "people"])


#: Persons that two lists of an analysis name, and those that tracks (of every third video) and votes confirm.
CORRELATED = """an AS (SELECT o_custkey % 50 AS video_id, 'p' || o_orderkey AS person_id, 'ana p' || (o_custkey % 11) AS identified_name, 'caption' AS name_source, o_orderpriority AS role, CAST(NULL AS VARCHAR) AS physical_description FROM orders WHERE o_custkey % 50 <> 7
      UNION ALL SELECT o_custkey % 50, 'q' || o_orderkey, 'Ana_P' || (o_custkey % 3), NULL, 'guest', o_orderstatus FROM orders WHERE o_custkey % 50 <> 7 AND o_orderstatus = 'O'
      UNION ALL SELECT o_custkey % 50, 'r' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' ' END, NULL, NULL, o_orderstatus FROM orders WHERE o_custkey % 50 <> 7 AND o_orderstatus = 'O'),
    v AS (SELECT o_custkey % 50 AS video_id, 'Ana_P' || (o_custkey % 7) AS person, count(*) AS n, CAST(sum(o_orderkey % 97) AS DOUBLE) / count(*) AS c, count(DISTINCT o_orderstatus) AS tracks FROM orders GROUP BY ALL),
    conf AS (SELECT video_id, person, CASE WHEN video_id % 3 = 0 THEN n * 2 ELSE n END AS total_frames, c AS avg_confidence, CASE WHEN video_id % 3 = 0 THEN tracks ELSE 1 END AS total_tracks, CASE WHEN video_id % 3 = 0 THEN 'tracks' ELSE 'votes' END AS method FROM v),
    a AS (SELECT *, nullif(lower(trim(replace(identified_name, '_', ' '))), '') AS name, true AS listed FROM an), c AS (SELECT *, lower(trim(replace(person, '_', ' '))) AS name FROM conf)"""


def _correlated(spark, sf):
    o = table(spark, sf, "orders")
    video = (F.col("o_custkey") % 50).alias("video_id")
    of = lambda mark, **fields: F.struct(F.concat(F.lit(mark), F.col("o_orderkey")).alias("person_id"), *[c.alias(n) for n, c in fields.items()])
    speaker = of("p", identified_name=F.concat(F.lit("ana p"), F.col("o_custkey") % 11), name_source=F.lit("caption"), role=F.col("o_orderpriority"))
    guest = of("q", identified_name=F.concat(F.lit("Ana_P"), F.col("o_custkey") % 3), role=F.lit("guest"), physical_description=F.col("o_orderstatus"))
    nobody = of("r", identified_name=F.when(F.col("o_orderkey") % 2 == 0, " "), role=F.lit(None).cast("string"), physical_description=F.col("o_orderstatus"))
    analyses = o.filter(F.col("o_custkey") % 50 != 7).select(video, F.array(speaker).alias("speakers"), F.when(F.col("o_orderstatus") == "O", F.array(guest, nobody)).alias("people"))
    votes = o.groupBy(video, F.concat(F.lit("Ana_P"), F.col("o_custkey") % 7).alias("person")).agg(
        F.count(F.lit(1)).alias("frame_count"), (F.sum(F.col("o_orderkey") % 97).cast("double") / F.count(F.lit(1))).alias("avg_confidence"), F.countDistinct("o_orderstatus").alias("total_tracks"))
    tracks = votes.filter("video_id % 3 = 0").withColumn("total_frames", F.col("frame_count") * 2)
    confirmed = FR.confirmed_or_voted(tracks, votes.drop("total_tracks"), video="video_id")
    return confirmed, FR.analysed_people(analyses, video="video_id", fields=["speakers", "on_screen_people", "participants", "key_people", "people"]), analyses


@query("correlate_people", f"""WITH {CORRELATED}
    SELECT video_id, name, person, total_frames, round(avg_confidence, 6) AS avg_confidence, total_tracks, method, person_id, identified_name, name_source, role, physical_description,
        CASE WHEN person IS NULL THEN 'analysis' WHEN listed IS NULL THEN 'vectors' ELSE 'both' END AS found_in FROM c FULL OUTER JOIN a USING (video_id, name)""")
def correlate_people(spark, sf):
    confirmed, people, _ = _correlated(spark, sf)
    return FR.correlate_people(confirmed, people, video="video_id").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("correlation_summary", f"""WITH {CORRELATED}, vids AS (SELECT video_id FROM a UNION SELECT video_id FROM c)
    SELECT video_id, EXISTS (SELECT 1 FROM a WHERE a.video_id = v.video_id) AS analysed, (SELECT count(*) FROM a WHERE a.video_id = v.video_id) AS people_listed, (SELECT count(name) FROM a WHERE a.video_id = v.video_id) AS people_named,
        (SELECT count(*) FROM c WHERE c.video_id = v.video_id) AS persons_confirmed, (SELECT count(DISTINCT a.name) FROM a JOIN c USING (video_id, name) WHERE a.video_id = v.video_id) AS names_shared FROM vids v""")
def correlation_summary(spark, sf):
    confirmed, people, analyses = _correlated(spark, sf)
    return FR.correlation_summary(confirmed, people, analyses, video="video_id")


_ROLLING = f"""WITH q AS (SELECT video_id, event_id, frame_number, confidence, CASE WHEN recognized THEN {QUALITY} END AS quality FROM frames)
    SELECT video_id, event_id, round(avg(confidence) OVER w, 6) AS rolling_confidence, round(avg(quality) OVER w, 6) AS rolling_quality FROM q WINDOW w AS (PARTITION BY video_id ORDER BY frame_number, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"""


def _rolling(spark, sf, **options):
    quality = F.when(F.col("recognized"), G.frame_quality(F.col("blur"), F.col("contrast"), F.col("brightness"), F.col("edges")))
    rows = view(spark, sf, "frames").withColumn("quality", quality).select("video_id", "event_id", "frame_number", "confidence", "quality")
    out = FR.rolling_means(rows, video="video_id", order=["frame_number", "event_id"], values=["confidence", "quality"], last=9, **options)
    return out.select("video_id", "event_id", F.round("rolling_confidence", 6).alias("rolling_confidence"), F.round("rolling_quality", 6).alias("rolling_quality"))


@query("rolling_means", _ROLLING, ("frames",))
def rolling_means(spark, sf):
    return _rolling(spark, sf)


@query("rolling_means_in_blocks", _ROLLING, ("frames",))
def rolling_means_in_blocks(spark, sf):
    """Blocks as short as the window, so that nearly every row looks into the halo."""
    return _rolling(spark, sf, block=9)
