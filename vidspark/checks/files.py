"""Sources and sinks: the given tables written to the run's shared folder, then read back."""

from uuid import uuid4

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import table
from vidspark.session import checkpoint_root
from vidspark.sources import logs


def folder(spark, name):
    checkpoint_root(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


@query("record_sets", "SELECT CAST(o_orderkey AS VARCHAR) AS comparison_id, CAST(o_custkey AS VARCHAR) AS image_id, o_orderpriority AS ground_truth FROM orders WHERE o_orderkey % 7 <> 3")
def record_sets(spark, sf):
    """JSON records of which one in seven is broken: those are set aside, the rest is read."""
    o, path = table(spark, sf, "orders"), folder(spark, "records")
    whole = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("comparison_id"), F.col("o_custkey").cast("string").alias("image_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("o_orderpriority").alias("ground_truth")))
    o.select(F.when(F.col("o_orderkey") % 7 == 3, F.concat(F.lit("{broken "), whole)).otherwise(whole).alias("value")).write.text(path)
    return logs.read_records(spark, path, multi_line=False).select("comparison_id", "image_id", "ground_truth")


@query("dated_partition", "SELECT person, reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'p' || o_custkey AS person, o_orderpriority AS reason FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT min(CAST(o_orderdate AS DATE)) FROM orders)) x GROUP BY ALL")
def dated_partition(spark, sf):
    """A log written in two appends, partitioned by day, of which one day is read."""
    o, path = table(spark, sf, "orders"), folder(spark, "rejections")
    rows = o.select(F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.concat(F.lit("p"), "o_custkey").alias("person"), F.col("o_orderpriority").alias("reason"), F.lit(None).cast("map<string,string>").alias("details"), F.lit("s").alias("source"), F.lit("b").alias("batch_id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey"))
    for half in (0, 1):
        logs.append_dated(rows.filter(F.col("o_orderkey") % 2 == half).drop("o_orderkey"), path)
    day = o.agg(F.min(F.col("o_orderdate").cast("date"))).scalar()
    return logs.read_dated(spark, path).filter(F.col("date") == day).groupBy("person", "reason").agg(F.count("*").alias("n"))


@query("image_listing", """WITH d AS (SELECT 'batch_' || lpad(CAST(doc_id % 40 AS VARCHAR), 4, '0') AS batch, strlen(coalesce(text, '')) + 1 AS n FROM documents)
    SELECT batch, CAST(ceil(count(*) / 50.0e0) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM d GROUP BY 1""")
def image_listing(spark, sf):
    """Two kinds of files in batch folders, written by the executors, fifty texts in each; one kind is listed, unopened."""
    path = folder(spark, "images")
    d = table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.concat(F.lit("batch_"), F.lpad((F.col("doc_id") % 40).cast("string"), 4, "0")).alias("batch"))
    for kind in ("text", "json"):
        d.repartition("batch").write.partitionBy("batch").option("maxRecordsPerFile", 50).mode("append").format(kind).save(path)
    return logs.list_images(spark, path, kinds=("txt",)).groupBy("batch").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("latest_report", "SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1")
def latest_report(spark, sf):
    """Two runs of a report, the older one written twice; the newest is read."""
    o, path = table(spark, sf, "orders"), folder(spark, "reports")
    report = o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    for run, rows in (("2024-01-01", report.filter("n < 0")), ("2024-01-01", report.orderBy("name").limit(1)), ("2024-02-01", report)):
        logs.write_report(rows, path, run_id=run)
    return logs.read_latest_report(spark, path, "name STRING, n LONG").select("name", "n")
