"""Readers and writers on small folders."""

import json

from pyspark.sql import functions as F

from vidspark.functions.scalars import in_days
from vidspark.sources import logs, tables


def test_records_skip_what_cannot_be_read(spark, tmp_path):
    for i in range(6):
        rec = {"comparison_id": f"c{i}", "image_id": f"i{i}", "timestamp": f"2024-01-0{i + 1}T10:00:00Z", "pipeline_a": {"status": "success", "confidence": 50.5}}
        (tmp_path / f"{i}.json").write_text(json.dumps(rec, indent=1))
    (tmp_path / "bad.json").write_text('{"comparison_id": "x", ')
    all_rows = logs.read_records(spark, str(tmp_path))
    assert all_rows.count() == 6 and all_rows.filter("pipeline_a.status = 'success'").count() == 6
    ranged = logs.read_records(spark, str(tmp_path), start="2024-01-02 10:00:00", end="2024-01-04 10:00:00", ids=["c1", "c3", "c5"])
    assert sorted(r.comparison_id for r in ranged.collect()) == ["c1", "c3"]


def test_dated_log_reads_one_partition(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(10).select(F.lit(None).cast("timestamp").alias("timestamp"), F.concat(F.lit("p"), "id").alias("person"), F.lit("blur").alias("reason"), F.create_map(F.lit("k"), F.lit("v")).alias("details"),
                                F.lit("s").alias("source"), F.lit("b").alias("batch_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"))
    logs.append_dated(df, path)
    logs.append_dated(df, path)
    day = logs.read_dated(spark, path, date="2024-01-02")
    assert day.count() == 6
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()


def test_csv_export_pads_missing_matches(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 00:00:00", "a.jpg", "d", True, "P", 91.5, [("P", 91.5), ("Q", 40.0)], 1, 2.5)], "ts string, filename string, domain string, recognized boolean, person string, confidence double, top_matches array<struct<person:string,confidence:double>>, face_count int, processing_time_ms double")
    logs.export_csv(log.withColumn("ts", F.col("ts").cast("timestamp")), str(tmp_path / "csv"))
    r = spark.read.csv(str(tmp_path / "csv"), header=True).first()
    assert (r.recognized, r.match_2_person, r.match_3_person, r.timestamp) == ("Yes", "Q", None, "2024-01-01T00:00:00")


def test_image_listing(spark, tmp_path):
    (tmp_path / "batch_0001").mkdir()
    for name in ("a.jpg", "b.PNG", "c.txt", "batch_0001/d.webp"):
        (tmp_path / name).write_bytes(b"x" * 10)
    rows = logs.list_images(spark, str(tmp_path)).collect()
    assert {(r.filename, r.batch, r.bytes) for r in rows} == {("a.jpg", None, 10), ("b.PNG", None, 10), ("d.webp", "batch_0001", 10)}


def test_latest_report(spark, tmp_path):
    for run, n in (("2024-01-01", 3), ("2024-01-02", 2)):
        logs.write_report(spark.range(n), str(tmp_path), run_id=run)
    assert logs.read_latest_report(spark, str(tmp_path), "id long").count() == 2


def test_bulk_insert_sets_bad_rows_aside(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [1.0]), (3, "b", None)], "vec_id long, domain string, embedding array<float>")
    tables.bulk_insert(df, str(tmp_path / "g"), str(tmp_path / "q"), dim=2)
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1
    assert {r.reject_reason for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {"wrong_dimension", "no_vector"}


def test_gallery_load_prunes_the_domain(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x/Ana_K_20240101_1.jpg", [1.0]), (2, "b", "y/Iva_20240101_1.jpg", [1.0]), (3, "a", "z/Ana_20240101_1.jpg", [])], "vec_id long, domain string, image_path string, embedding array<float>")
    df.write.partitionBy("domain").parquet(str(tmp_path / "g"))
    g = tables.load_gallery(spark, str(tmp_path / "g"), domain="a")
    assert [(r.vec_id, r.person) for r in g.collect()] == [(1, "Ana_K")]
    assert "PartitionFilters: [isnotnull(domain" in g._jdf.queryExecution().executedPlan().toString()


def test_day_range_and_the_last_second(spark):
    t = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 23:59:59",), ("2024-01-02 23:59:59.5",), ("2024-01-03 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in t.select(in_days(F.col("t"), "2024-01-01", "2024-01-02")).collect()] == [True, True, True, False]
    assert [r[0] for r in t.select(in_days(F.col("t"), "2024-01-01", "2024-01-02", whole_last_second=False)).collect()] == [True, True, False, False]
