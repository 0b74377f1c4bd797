"""Gallery, domain and catalog statistics."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import table, view
from vidspark.operators import catalog as C

D = "regexp_replace(regexp_replace(filename, '\\.[a-z]+$', ''), '_[0-9]{4}-[0-9]{2}-[0-9]{2}.*$', '')"
PER = f"per AS (SELECT domain, {D} AS person, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS bytes FROM catalog_files GROUP BY ALL)"


def files(spark, sf):
    return view(spark, sf, "catalog_files")


@query("persons_with_vectors", "SELECT g.vec_id, p.name, g.domain FROM gallery g JOIN persons p ON p.person_id = g.person_id", ("persons", "gallery"))
def persons_with_vectors(spark, sf):
    return view(spark, sf, "gallery").select("vec_id", "person_id", "domain").join(view(spark, sf, "persons").select("person_id", "name"), "person_id").select("vec_id", "name", "domain")


@query("vectors_per_person", "SELECT p.person_id, name, p.domain, count(g.vec_id) AS n FROM persons p LEFT JOIN gallery g ON g.person_id = p.person_id GROUP BY ALL", ("persons", "gallery"))
def vectors_per_person(spark, sf):
    return C.vectors_per_person(view(spark, sf, "persons"), view(spark, sf, "gallery")).select("person_id", "name", "domain", "n")


@query("gallery_stats", "WITH n AS (SELECT p.person_id, p.domain, count(g.vec_id) AS n FROM persons p LEFT JOIN gallery g ON g.person_id = p.person_id GROUP BY ALL) SELECT domain, count(*) AS persons, CAST(sum(n) AS BIGINT) AS vectors, round(sum(n) / count(*), 1) AS vectors_per_person FROM n GROUP BY ROLLUP(domain)", ("persons", "gallery"))
def gallery_stats(spark, sf):
    return C.gallery_stats(view(spark, sf, "persons"), view(spark, sf, "gallery"))


@query("domain_stats", """SELECT 'd' || c_nationkey % 4 AS domain, 'people' AS kind, c_mktsegment AS class, count(*) AS n, CAST(NULL AS BIGINT) AS accepted FROM customer GROUP BY ALL
    UNION ALL SELECT 'd' || l_suppkey % 4, 'images', l_returnflag, count(*), NULL FROM lineitem GROUP BY ALL
    UNION ALL SELECT 'd' || o_custkey % 4, 'batches', o_orderstatus, count(*), CAST(sum(o_orderkey % 50 + o_custkey % 20) AS BIGINT) FROM orders GROUP BY ALL""")
def domain_stats(spark, sf):
    people = table(spark, sf, "customer").select(F.concat(F.lit("d"), F.col("c_nationkey") % 4).alias("domain"), F.col("c_mktsegment").alias("status"))
    images = table(spark, sf, "lineitem").select(F.concat(F.lit("d"), F.col("l_suppkey") % 4).alias("domain"), F.col("l_returnflag").alias("source"))
    batches = table(spark, sf, "orders").select(F.concat(F.lit("d"), F.col("o_custkey") % 4).alias("domain"), F.col("o_orderstatus").alias("status"),
        F.array(F.struct((F.col("o_orderkey") % 50).alias("images_accepted")), F.struct((F.col("o_custkey") % 20).alias("images_accepted"))).alias("people"))
    return C.domain_stats(people, images, batches)


@query("catalog_stats", f"""WITH {PER}, m AS (SELECT domain, images, row_number() OVER (PARTITION BY domain ORDER BY images) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM per),
    o AS (SELECT domain, arg_min(filename, bytes * 1000000000 + file_id) AS oldest, arg_max(filename, bytes * 1000000000 + file_id) AS newest FROM catalog_files GROUP BY 1)
    SELECT per.domain, CAST(sum(images) AS BIGINT) AS photos, count(*) AS persons, CAST(sum(per.bytes) AS BIGINT) AS bytes, round(avg(images), 4) AS avg_images, max(med) AS median_images, min(images) AS min_images, max(images) AS max_images, any_value(oldest) AS oldest, any_value(newest) AS newest,
      100 - CASE WHEN per.domain = 'en' THEN 0 ELSE 20 END - least(20, count(*) FILTER (images < 5)) AS health, concat_ws('; ', CASE WHEN per.domain <> 'en' THEN 'no index file' END, CASE WHEN count(*) FILTER (images < 5) > 0 THEN count(*) FILTER (images < 5) || ' persons have fewer than 5 images' END) AS warnings
    FROM per JOIN (SELECT domain, images AS med FROM m WHERE rn = n // 2 + 1) x USING (domain) JOIN o USING (domain) GROUP BY per.domain""", ("catalog_files",))
def catalog_stats(spark, sf):
    f = files(spark, sf).withColumn("stamp", F.col("bytes") * 1000000000 + F.col("file_id"))
    s = C.catalog_stats(f, has_index=F.col("domain") == "en")
    return s.withColumn("avg_images", F.round("avg_images", 4)).withColumn("warnings", F.array_join("warnings", "; "))


@query("file_types", "WITH e AS (SELECT domain, regexp_extract(filename, '(\\.[a-z]+)$', 1) AS extension, count(*) AS files FROM catalog_files GROUP BY ALL) SELECT domain, extension, files, round(files / sum(files) OVER (PARTITION BY domain) * 100, 1) AS share FROM e", ("catalog_files",))
def file_types(spark, sf):
    return C.file_types(files(spark, sf))


@query("count_histogram", f"""WITH {PER}, b AS (SELECT domain, CASE WHEN images <= 1 THEN '1' WHEN images <= 5 THEN '2-5' WHEN images <= 10 THEN '6-10' WHEN images <= 20 THEN '11-20' WHEN images <= 50 THEN '21-50' WHEN images <= 100 THEN '51-100' WHEN images <= 200 THEN '101-200' ELSE '200+' END AS class, count(*) AS persons FROM per GROUP BY ALL)
    SELECT *, round(persons / sum(persons) OVER (PARTITION BY domain) * 100, 1) AS share FROM b""", ("catalog_files",))
def count_histogram(spark, sf):
    return C.count_histogram(C.images_per_person(files(spark, sf)))


@query("storage_totals", f"WITH f AS (SELECT storage, domain, {D} AS person, bytes FROM catalog_files) SELECT storage, domain, count(*) AS photos, count(DISTINCT person) AS persons, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY CUBE(storage, domain)", ("catalog_files",))
def storage_totals(spark, sf):
    return C.storage_totals(files(spark, sf))


@query("person_locations", f"WITH f AS (SELECT storage, {D} AS person FROM catalog_files) SELECT person, count(*) AS images, array_to_string(list_sort(list(DISTINCT storage)), ',') AS storages FROM f GROUP BY person", ("catalog_files",))
def person_locations(spark, sf):
    return C.person_locations(files(spark, sf)).withColumn("storages", F.array_join("storages", ","))


@query("top_and_bottom", f"WITH f AS (SELECT {D} AS person, count(*) AS images FROM catalog_files GROUP BY 1) (SELECT person, images, 'top' AS side FROM f ORDER BY images DESC, person LIMIT 5) UNION ALL (SELECT person, images, 'bottom' FROM f ORDER BY images, person LIMIT 5)", ("catalog_files",))
def top_and_bottom(spark, sf):
    per = C.images_per_person(files(spark, sf), keys=())
    return C.top_and_bottom(per.select("person", "images"), n=5)


@query("images_of_person", f"""SELECT {D} AS person, CASE WHEN starts_with(filename, 'Ana-') THEN split_part(split_part(filename, '_', 1), '.', 1) ELSE nullif(regexp_extract(filename, '_([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') END AS day, count(*) AS images
    FROM catalog_files GROUP BY ALL""", ("catalog_files",))
def images_of_person(spark, sf):
    """Two name rules meet: the person ends before a date, the day is the first part with a hyphen, so a hyphen in the name is taken for it."""
    f = files(spark, sf)
    return C.images_of_person(f.filter("storage = 'local'"), f.filter("storage = 'remote'"))


@query("images_containing_name", "SELECT 'src1' AS person, count(*) AS images FROM catalog_files WHERE contains(filename, 'src1')", ("catalog_files",))
def images_containing_name(spark, sf):
    f = files(spark, sf)
    return C.images_of_person(f.filter("storage = 'local'"), f.filter("storage = 'remote'"), strict_reference="src1")


@query("reconcile", """WITH f AS (SELECT DISTINCT 'd' || l_suppkey % 3 AS domain, 'f' || l_partkey AS filename FROM lineitem WHERE l_returnflag = 'A'), v AS (SELECT 'd' || l_suppkey % 3 AS domain, 'f' || l_partkey AS filename, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)
    SELECT domain, count(f.filename) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS vectors, count(*) FILTER (f.filename IS NOT NULL AND n IS NOT NULL) AS files_with_vector, count(*) FILTER (n IS NULL) AS files_without_vector, count(*) FILTER (f.filename IS NULL) AS orphan_vectors FROM f FULL OUTER JOIN v USING (domain, filename) GROUP BY domain""")
def reconcile(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("d"), F.col("l_suppkey") % 3).alias("domain"), F.concat(F.lit("f"), "l_partkey").alias("filename"), "l_returnflag", "l_discount", "l_tax")
    return C.reconcile(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag <> 'A'"))


@query("batch_numbers", "SELECT domain, filename, printf('batch_%04d', CAST(floor((row_number() OVER (PARTITION BY domain ORDER BY filename) - 1) / 150) AS BIGINT) + 1) AS batch FROM catalog_files", ("catalog_files",))
def batch_numbers(spark, sf):
    return C.batch_numbers(files(spark, sf).select("domain", "filename"), size=150)


@query("processing_status", """WITH p AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status, CAST(o_orderdate AS DATE) AS day, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'success' END, 'success']) AS ps FROM orders)
    SELECT count(*) FILTER (status = 'pending') AS total_in_queue, count(*) FILTER (status = 'completed' AND day = DATE '1995-06-17' AND ps = 'success') AS processed_today, count(*) FILTER (status = 'failed' AND day = DATE '1995-06-17') AS failed_today, count(*) FILTER (status = 'pending') AS remaining FROM p""")
def processing_status(spark, sf):
    o = table(spark, sf, "orders")
    b = o.select(F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "completed").otherwise("failed").alias("status"), F.col("o_orderdate").alias("created_at"),
                 F.array(F.struct(F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("success").alias("status")), F.struct(F.lit("success").alias("status"))).alias("people"))
    return C.processing_status(b, today="1995-06-17")


@query("storage_usage", "SELECT source AS class, count(*) AS files, round(sum(n_chars) / 1048576, 2) AS megabytes FROM documents GROUP BY 1")
def storage_usage(spark, sf):
    return C.storage_usage(table(spark, sf, "documents").withColumnRenamed("source", "class"), by="class", size="n_chars")


@query("token_cost", """SELECT model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(prompt_tokens) / 1e6 * CASE model WHEN 'model-a' THEN 0.4e0 WHEN 'model-b' THEN 2.0e0 WHEN 'model-c' THEN 0.1e0 ELSE 0 END + sum(completion_tokens) / 1e6 * CASE model WHEN 'model-a' THEN 1.6e0 WHEN 'model-b' THEN 8.0e0 WHEN 'model-c' THEN 0.4e0 ELSE 0 END, 6) AS cost FROM token_usage GROUP BY 1""", ("token_usage",))
def token_cost(spark, sf):
    return C.token_cost(view(spark, sf, "token_usage"), prices=[("model-a", 0.4, 1.6), ("model-b", 2.0, 8.0), ("model-c", 0.1, 0.4)])


@query("duplicate_ids", "SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return C.duplicate_ids(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "key"), key="key")
