"""Unions, differences and duplicates."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import table, view
from vidspark.operators import logs as L


@query("shard_union", "SELECT l_returnflag AS shard, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1")
def shard_union(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("shard"))
    shards = [li.filter(F.col("shard") == s) for s in ("A", "N", "R")]
    return L.concat_shards(*shards).groupBy("shard").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("first_source_wins", """WITH u AS (SELECT full_name AS name, 'trends' AS source, 0 AS r FROM names WHERE domain = 'north' UNION ALL SELECT upper(full_name), 'news', 1 FROM names WHERE domain = 'south' UNION ALL SELECT lower(full_name), 'wikidata', 2 FROM names)
    SELECT name, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY r, name) AS rn FROM u) x WHERE rn = 1""", ("names",))
def first_source_wins(spark, sf):
    n = view(spark, sf, "names")
    sources = [("trends", n.filter("domain = 'north'").select(F.col("full_name").alias("name"))), ("news", n.filter("domain = 'south'").select(F.upper("full_name").alias("name"))), ("wikidata", n.select(F.lower("full_name").alias("name")))]
    return L.first_source_wins(sources)


NAMED = "SELECT l_returnflag, l_linestatus, 'n' || l_partkey || '_' || l_suppkey AS name FROM lineitem"


@query("name_sets", f"""SELECT name, 'only_a' AS side FROM (SELECT name FROM ({NAMED}) q WHERE l_returnflag = 'A' EXCEPT SELECT name FROM ({NAMED}) q WHERE l_linestatus = 'O') x
    UNION ALL SELECT name, 'both' FROM (SELECT name FROM ({NAMED}) q WHERE l_returnflag = 'A' INTERSECT SELECT name FROM ({NAMED}) q WHERE l_linestatus = 'O') y""")
def name_sets(spark, sf):
    n = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.concat(F.lit("n"), "l_partkey", F.lit("_"), "l_suppkey").alias("name"))
    a, b = n.filter("l_returnflag = 'A'").select("name"), n.filter("l_linestatus = 'O'").select("name")
    return a.subtract(b).withColumn("side", F.lit("only_a")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@query("new_content", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE lang <> 'de' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'de') GROUP BY md5(text)")
def new_content(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    new, old = d.filter("lang <> 'de'").drop("lang"), d.filter("lang = 'de'")
    kept = L.drop_known_content(new, old, digest="digest", order="doc_id")
    return kept.join(new.groupBy("digest").agg(F.count("*").alias("copies")), "digest").select("doc_id", "copies")


@query("first_per_hash", """WITH h AS (SELECT seq, person_id, array_to_string(list_transform(pixels, lambda p: CASE WHEN p > list_avg(pixels) THEN '1' ELSE '0' END), '') AS hash FROM hash_images)
    SELECT hash, min(seq) AS seq, arg_min(person_id, seq) AS person_id, count(*) AS copies FROM h GROUP BY hash""", ("hash_images",))
def first_per_hash(spark, sf):
    return L.first_per_hash(view(spark, sf, "hash_images"))
