"""Vector joins and vector arithmetic."""

from uuid import uuid4

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import table, view
from vidspark.functions import vectors as V
from vidspark.operators import search
from vidspark.operators.index import build_index, insert, open_index, search_index
from vidspark.operators.common import rounded
from vidspark.session import checkpoint_root

DIST = "round(list_cosine_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6) + 0.0"
RAW = "list_cosine_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
# All pairs of one domain, as the oracles see them.
PAIRS = f"""pairs AS (SELECT p.probe_id, p.image_id, g.vec_id, g.person_id, p.domain, p.x_pct, p.y_pct, p.w_pct, p.h_pct, {RAW.format(a='p.embedding', b='g.embedding')} AS d
    FROM probes p JOIN gallery g ON p.domain = g.domain)"""


@query("knn_exact", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, vec_id) AS rank FROM pairs WHERE d < 0.85)
    SELECT r.probe_id, r.rank, r.vec_id, n.name AS person, round(r.d, 6) + 0.0 AS distance FROM r JOIN persons n ON n.person_id = r.person_id WHERE rank <= 5""", ("persons", "gallery", "probes"))
def knn_exact(spark, sf, **options):
    hits = search.knn_join(view(spark, sf, "probes"), view(spark, sf, "gallery"), k=5, threshold=0.85, **options)
    named = hits.join(view(spark, sf, "persons").select("person_id", F.col("name").alias("person")), "person_id")
    return named.select("probe_id", F.col("rank").cast("long").alias("rank"), "vec_id", "person", rounded("distance", 6).alias("distance"))


@query("knn_cut_after", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, vec_id) AS rank FROM pairs)
    SELECT probe_id, CAST(rank AS BIGINT) AS rank, vec_id, round(d, 6) + 0.0 AS distance, round((1 - round(d, 12)) * 100, 2) AS confidence_pct FROM r WHERE rank <= 3 AND d <= 0.8""", ("gallery", "probes"))
def knn_cut_after(spark, sf):
    hits = search.knn_join(view(spark, sf, "probes"), view(spark, sf, "gallery"), k=3, threshold=0.8, cut="after", cells=8, block_rows=100, carry=())
    return hits.select("probe_id", F.col("rank").cast("long").alias("rank"), "vec_id", rounded("distance", 6).alias("distance"), V.confidence_pct(F.col("distance")).alias("confidence_pct"))


@query("knn_ivf")
def knn_ivf(spark, sf):
    hits = search.knn_join(view(spark, sf, "probes"), view(spark, sf, "gallery"), k=5, threshold=0.85, method="ivf", cells=16, nprobe=8, block_rows=64)
    return hits.select("probe_id", "rank", "vec_id", "person_id", rounded("distance", 6).alias("distance"))


@query("knn_ivf_all_cells", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, vec_id) AS rank FROM pairs WHERE d < 0.85)
    SELECT probe_id, rank, vec_id, person_id, round(d, 6) + 0.0 AS distance FROM r WHERE rank <= 5""", ("gallery", "probes"))
def knn_ivf_all_cells(spark, sf, cells=8, nprobe=8, block_rows=64):
    """The approximate join with every cell visited is exact."""
    hits = search.knn_join(view(spark, sf, "probes"), view(spark, sf, "gallery"), k=5, threshold=0.85, method="ivf", cells=cells, nprobe=nprobe, block_rows=block_rows)
    return hits.select("probe_id", F.col("rank").cast("long").alias("rank"), "vec_id", "person_id", rounded("distance", 6).alias("distance"))


@query("knn_index_all_cells", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, vec_id) AS rank FROM pairs WHERE d < 0.85)
    SELECT probe_id, rank, vec_id, person_id, round(d, 6) + 0.0 AS distance FROM r WHERE rank <= 5""", ("gallery", "probes"))
def knn_index_all_cells(spark, sf, **options):
    """A stored index, built over half of the gallery, grown by the other half, opened again; every cell visited."""
    path, g = f"{checkpoint_root(spark)}/index-{uuid4().hex}", view(spark, sf, "gallery")
    first = F.col("vec_id") % 2 == 0
    insert(build_index(g.filter(first), path, cells=40), g.filter(~first))
    index = open_index(spark, path)
    hits = search_index(index, view(spark, sf, "probes"), k=5, threshold=0.85, nprobe=index.cells, **options)
    return hits.select("probe_id", F.col("rank").cast("long").alias("rank"), "vec_id", "person_id", rounded("distance", 6).alias("distance"))


@query("top_by_distance", f"""WITH {PAIRS} SELECT probe_id, vec_id, round(d, 6) + 0.0 AS distance FROM pairs WHERE d < 0.9 ORDER BY d, probe_id, vec_id LIMIT 50""".replace("p.domain = g.domain", "p.domain = g.domain AND p.probe_id < g.vec_id"), ("gallery", "probes"))
def top_by_distance(spark, sf):
    """ORDER BY distance LIMIT k over all pairs: a pair among the best 50 has rank
    51 or better for its probe (at most 50 closer partners, and the probe itself)."""
    hits = search.knn_join(view(spark, sf, "probes"), view(spark, sf, "gallery"), k=51, threshold=0.9, carry=())
    once = hits.filter(F.col("probe_id") < F.col("vec_id"))
    return once.orderBy("distance", "probe_id", "vec_id").limit(50).select("probe_id", "vec_id", rounded("distance", 6).alias("distance"))


@query("pair_distances", f"""WITH pairs AS (SELECT a.label AS grp, a.vec_id, b.vec_id AS other, {RAW.format(a='a.embedding', b='b.embedding')} AS d FROM embeddings a JOIN embeddings b ON a.label = b.label)
    SELECT CAST(grp AS BIGINT) AS grp, vec_id, count(*) AS neighbours, round(min(d) FILTER (other <> vec_id), 6) AS min_distance, round(avg(d) FILTER (other <> vec_id), 6) AS mean_distance
    FROM pairs WHERE d < 0.9 GROUP BY ALL""")
def pair_distances(spark, sf, **options):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("grp"), "embedding")
    s = search.neighbour_stats(v, group="grp", threshold=0.9, **options)
    return s.select("grp", "vec_id", "neighbours", F.round("min_distance", 6).alias("min_distance"), F.round("mean_distance", 6).alias("mean_distance"))


@query("consensus", f"""WITH pairs AS (SELECT a.grp, a.copy_id AS id, b.copy_id AS other, {RAW.format(a='a.embedding', b='b.embedding')} AS d FROM copies a JOIN copies b ON a.grp = b.grp),
    c AS (SELECT grp, id, count(*) AS n FROM pairs WHERE d < 0.02 GROUP BY ALL),
    best AS (SELECT grp, id, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, id) AS rn FROM c) x WHERE rn = 1 AND n >= 4)
    SELECT p.grp, p.other AS copy_id, b.id AS centre_id, b.n AS cluster_size, round(p.d, 6) + 0.0 AS distance FROM best b JOIN pairs p ON p.grp = b.grp AND p.id = b.id WHERE p.d < 0.02""", ("copies",))
def consensus(spark, sf, **options):
    c = search.consensus(view(spark, sf, "copies"), group="grp", id="copy_id", threshold=0.02, min_size=4, **options)
    return c.select("grp", "copy_id", "centre_id", "cluster_size", rounded("distance", 6).alias("distance"))


@query("consensus_by_label", f"""WITH v AS (SELECT CAST(label AS BIGINT) AS grp, vec_id AS id, embedding FROM embeddings),
    pairs AS (SELECT a.grp, a.id, b.id AS other, {RAW.format(a='a.embedding', b='b.embedding')} AS d FROM v a JOIN v b ON a.grp = b.grp),
    c AS (SELECT grp, id, count(*) AS n FROM pairs WHERE d < 0.85 GROUP BY ALL),
    best AS (SELECT grp, id, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, id) AS rn FROM c) x WHERE rn = 1 AND n >= 4)
    SELECT p.grp, p.other AS vec_id, b.id AS centre_id, b.n AS cluster_size FROM best b JOIN pairs p ON p.grp = b.grp AND p.id = b.id WHERE p.d < 0.85""")
def consensus_by_label(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("grp"), "embedding")
    return search.consensus(v, group="grp", threshold=0.85).select("grp", "vec_id", "centre_id", "cluster_size")


@query("validate_references", f"""WITH v AS (SELECT CAST(label AS BIGINT) AS person_id, vec_id, embedding FROM embeddings),
    pairs AS (SELECT c.copy_id, c.grp, r.vec_id, {RAW.format(a='c.embedding', b='r.embedding')} AS d FROM copies c JOIN v o ON o.vec_id = c.grp JOIN v r ON r.person_id = o.person_id)
    SELECT copy_id, grp, round(min(d), 6) + 0.0 AS min_distance, arg_min(vec_id, d) AS best_ref, min(vec_id) FILTER (d < 0.8) AS first_passing_ref, coalesce(bool_or(d < 0.8), false) AS accepted FROM pairs GROUP BY copy_id, grp""", ("copies",))
def validate_references(spark, sf, **options):
    v = table(spark, sf, "embeddings")
    refs = v.select(F.col("label").alias("person_id"), F.col("vec_id").alias("ref_idx"), "embedding")
    cands = view(spark, sf, "copies").join(v.select(F.col("vec_id").alias("grp"), F.col("label").alias("person_id")), "grp")
    out = search.validate_against(cands, refs, on="person_id", id="copy_id", threshold=0.8, **options)
    return out.select("copy_id", "grp", rounded("min_distance", 6).alias("min_distance"), "best_ref", "first_passing_ref", "accepted")


@query("verify_single", f"""WITH ref AS (SELECT label, vec_id AS ref_id, embedding AS r FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) x WHERE rn = 1)
    SELECT vec_id, ref_id, {DIST.format(a='embedding', b='r')} AS distance, {RAW.format(a='embedding', b='r')} <= 0.9 AS verified FROM embeddings JOIN ref USING (label)""")
def verify_single(spark, sf):
    v = table(spark, sf, "embeddings")
    ref = v.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(v, ["label", "vec_id"])
    named = v.join(ref.select("label", F.col("vec_id").alias("ref_id")), "label")
    out = search.verify_single(named, ref, on="label", threshold=0.9)
    return out.select("vec_id", "ref_id", rounded("distance", 6).alias("distance"), "verified")


@query("cosine_variants", f"""WITH m AS (SELECT a.vec_id, a.embedding, b.embedding AS nxt FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, {DIST.format(a='embedding', b='nxt')} AS distance, round({RAW.format(a='embedding', b='nxt')}, 4) + 0.0 AS distance_eps, round(1 - {RAW.format(a='embedding', b='nxt')}, 6) + 0.0 AS confidence FROM m""")
def cosine_variants(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    m = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt")), "vec_id")
    d = V.cosine_distance(F.col("embedding"), F.col("nxt"))
    return m.select("vec_id", rounded(d, 6).alias("distance"), rounded(V.cosine_distance_eps(F.col("embedding"), F.col("nxt")), 4).alias("distance_eps"), rounded(V.confidence(d), 6).alias("confidence"))


@query("sql_functions", f"""WITH m AS (SELECT a.vec_id, a.embedding, b.embedding AS nxt FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, {DIST.format(a='embedding', b='nxt')} AS distance, 'Ana_' || vec_id AS safe, round(CASE WHEN vec_id % 150 >= 100 THEN 0.0 ELSE (100 - vec_id % 150) * 100 / (20000.0e0 - (100 - vec_id % 150) * 100) END, 6) AS overlap FROM m""")
def sql_functions(spark, sf):
    """The functions registered for spark.sql."""
    from vidspark.functions.sql import register_functions

    register_functions(spark)
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return spark.sql("""SELECT a.vec_id, round(cosine_distance(a.embedding, b.embedding), 6) + 0D AS distance, safe_name(concat('Ána ', a.vec_id)) AS safe,
        round(iou(0D, 0D, 100D, 100D, a.vec_id % 150, 0D, a.vec_id % 150 + 100, 100D), 6) AS overlap FROM {e} a JOIN {e} b ON b.vec_id = a.vec_id + 1""", e=e)


def ragged(df, key):
    """Some vectors missing, some of another length."""
    k = F.col(key)
    return df.withColumn("embedding", F.when(k % 9 == 4, F.lit(None)).when(k % 11 == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))


@query("knn_ragged", f"""WITH {PAIRS}, ok AS (SELECT * FROM pairs WHERE NOT (probe_id % 9 = 4 OR probe_id % 11 = 3 OR vec_id % 9 = 4 OR vec_id % 11 = 3) AND d < 0.85), r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, vec_id) AS rank FROM ok)
    SELECT probe_id, rank, vec_id, round(d, 6) + 0.0 AS distance FROM r WHERE rank <= 5""", ("gallery", "probes"))
def knn_ragged(spark, sf):
    """Rows without a vector, or with one of another length, are left out on both sides."""
    hits = search.knn_join(ragged(view(spark, sf, "probes"), "probe_id"), ragged(view(spark, sf, "gallery"), "vec_id"), k=5, threshold=0.85, carry=())
    return hits.select("probe_id", F.col("rank").cast("long").alias("rank"), "vec_id", rounded("distance", 6).alias("distance"))


@query("vectors_set_aside", """SELECT vec_id, CASE WHEN vec_id % 9 = 4 THEN 'no_vector' ELSE 'wrong_dimension' END AS reject_reason FROM embeddings WHERE vec_id % 9 = 4 OR vec_id % 11 = 3""")
def vectors_set_aside(spark, sf):
    from vidspark.sources.tables import split_valid

    return split_valid(ragged(table(spark, sf, "embeddings"), "vec_id"), dim=64, keys=("vec_id",))[1].select("vec_id", "reject_reason")


@query("valid_vectors", "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS valid_64, count(*) FILTER (len(embedding) = 512) AS valid_512 FROM embeddings GROUP BY ALL")
def valid_vectors(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("n"), F.count_if(V.valid_vector(F.col("embedding"), 64)).alias("valid_64"),
        F.count_if(V.valid_vector(F.col("embedding"), 512)).alias("valid_512"))


BLOCKS = {"broadcast_bytes": 0, "block_rows": 64}


def in_blocks(name, run):
    """The same query with the block path forced, against the same SQL."""
    from vidspark.checks.registry import ORACLES

    query(f"{name}_in_blocks", ORACLES[name])(run)


in_blocks("knn_exact", lambda spark, sf: knn_exact(spark, sf, cells=8, **BLOCKS))
in_blocks("pair_distances", lambda spark, sf: pair_distances(spark, sf, cells=4, **BLOCKS))
in_blocks("consensus", lambda spark, sf: consensus(spark, sf, **BLOCKS))
in_blocks("validate_references", lambda spark, sf: validate_references(spark, sf, **BLOCKS))
in_blocks("knn_ivf_all_cells", lambda spark, sf: knn_ivf_all_cells(spark, sf, cells=None, nprobe=search.MAX_CELLS, block_rows=None))
in_blocks("knn_index_all_cells", lambda spark, sf: knn_index_all_cells(spark, sf, broadcast_bytes=0, block_rows=64))
