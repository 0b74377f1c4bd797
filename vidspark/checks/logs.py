"""Recognition and rejection logs."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import table, view
from vidspark.functions import scalars as S
from vidspark.operators import logs as L

SUM = """count(*) AS total_photos, count(*) FILTER (recognized) AS recognized_count, count(*) FILTER (NOT recognized) AS unrecognized_count, round(count(*) FILTER (recognized) / count(*) * 100, 2) AS recognition_rate, count(DISTINCT person) AS unique_persons,
    CAST(round(avg(confidence), 2) AS DOUBLE) AS avg_confidence"""


@query("log_summary", f"SELECT batch_id, {SUM} FROM rec_log GROUP BY 1", ("rec_log",))
def log_summary(spark, sf):
    return L.log_summary(view(spark, sf, "rec_log"))


@query("log_persons", "SELECT DISTINCT batch_id, person FROM rec_log WHERE person IS NOT NULL", ("rec_log",))
def log_persons(spark, sf):
    return L.log_persons(view(spark, sf, "rec_log"))


@query("recent_batches", f"SELECT batch_id, strftime(last_ts, '%Y-%m-%d') AS last_ts, total_photos, recognized_count, unique_persons FROM (SELECT batch_id, max(ts) AS last_ts, {SUM} FROM rec_log GROUP BY 1) x ORDER BY x.last_ts DESC, batch_id LIMIT 12", ("rec_log",))
def recent_batches(spark, sf):
    b = L.recent_batches(view(spark, sf, "rec_log"), n=12)
    return b.select("batch_id", F.date_format("last_ts", "yyyy-MM-dd").alias("last_ts"), "total_photos", "recognized_count", "unique_persons")


@query("rejection_summary", "SELECT reason, person, count(*) AS rejections, CASE WHEN person IS NOT NULL THEN 2 WHEN reason IS NOT NULL THEN 1 ELSE 3 END AS level FROM (SELECT reason, 'p' || l_partkey % 50 AS person FROM rec_log WHERE reason IS NOT NULL) x GROUP BY GROUPING SETS ((reason), (person), ())", ("rec_log",))
def rejection_summary(spark, sf):
    r = view(spark, sf, "rec_log").filter("reason IS NOT NULL").select("reason", F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("person"))
    return L.rejection_summary(r)


@query("rejections_of_day", "SELECT reason, count(*) AS rejections FROM rec_log WHERE reason IS NOT NULL AND CAST(ts AS DATE) = DATE '1996-05-05' GROUP BY 1", ("rec_log",))
def rejections_of_day(spark, sf):
    r = view(spark, sf, "rec_log").filter("reason IS NOT NULL").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return L.rejection_summary(r, date="1996-05-05").filter("level = 1").select("reason", "rejections")


@query("reason_histogram", "SELECT batch_id, reason, count(*) AS n FROM rec_log WHERE reason IS NOT NULL GROUP BY ALL", ("rec_log",))
def reason_histogram(spark, sf):
    return L.reason_histogram(view(spark, sf, "rec_log"), by=["batch_id"])


@query("session_counters", "SELECT batch_id, count(*) AS total, count(*) FILTER (recognized) AS successes, count(*) FILTER (NOT recognized) AS failures FROM rec_log GROUP BY 1", ("rec_log",))
def session_counters(spark, sf):
    return L.session_counters(view(spark, sf, "rec_log"), session="batch_id", success=F.col("recognized"))


def entries(spark, sf):
    """Log rows whose stored result has one of four layouts, decoded from JSON text."""
    r = view(spark, sf, "rec_log")
    p, c = F.col("person"), F.col("confidence")
    other = F.concat(F.lit("x_"), F.col("l_partkey") % 9)
    full = F.struct(F.array(F.struct(F.concat(F.lit("a_"), p).alias("person_name"), F.struct(c.alias("confidence_percentage"), F.lit(3).alias("occurrences"), F.lit(0.25).alias("min_distance"), F.lit(-0.5).alias("weighted_score")).alias("metrics")),
                            F.struct(other.alias("person_name"), F.struct(F.lit(41.5).alias("confidence_percentage"), F.lit(1).alias("occurrences"), F.lit(0.5).alias("min_distance"), F.lit(0.125).alias("weighted_score")).alias("metrics"))).alias("all_detected_matches"))
    best = F.struct(F.struct(p.alias("display_name"), F.struct(c.alias("confidence_percentage"), F.lit(2).alias("occurrences")).alias("confidence_metrics")).alias("best_match"), F.array(F.struct(other.alias("name"), F.lit(30.25).alias("confidence"))).alias("all_matches"))
    blank = F.lit(None).cast("string")
    plain = F.struct(F.array(F.struct(p.alias("person"), blank.alias("name"), c.alias("confidence")), F.struct(blank.alias("person"), other.alias("name"), F.lit(0.0).alias("confidence"))).alias("matches"))
    single = F.struct(p.alias("person"), c.alias("confidence"))
    k = F.col("l_linenumber") % 4
    text = F.when(~F.col("recognized"), F.lit("{}")).when(k == 0, F.to_json(full)).when(k == 1, F.to_json(best)).when(k == 2, F.to_json(plain)).otherwise(F.to_json(single))
    return r.withColumn("result", F.from_json(text, S.RESULT_SCHEMA)).withColumn("top_matches", S.top_matches(F.col("result")))


TOP = """SELECT *, 'x_' || l_partkey % 9 AS other, l_linenumber % 4 AS k FROM rec_log"""


@query("top_matches", f"""SELECT filename, 1 AS rank, CASE k WHEN 0 THEN 'a ' || person ELSE person END AS person, confidence, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 END AS occurrences, CASE k WHEN 0 THEN 0.25 END AS min_distance, CASE k WHEN 0 THEN -0.5 END AS weighted_score FROM ({TOP}) t WHERE recognized
    UNION ALL SELECT filename, 2, CASE k WHEN 0 THEN replace(other, '_', ' ') ELSE other END, CASE k WHEN 0 THEN 41.5 WHEN 1 THEN 30.25 END, CASE k WHEN 0 THEN 1 END, CASE k WHEN 0 THEN 0.5 END, CASE k WHEN 0 THEN 0.125 END FROM ({TOP}) t WHERE recognized AND k < 3""".replace("0.25 END", "0.25e0 END").replace("-0.5 END", "-0.5e0 END").replace("0.5 END", "0.5e0 END").replace("0.125 END", "0.125e0 END").replace("41.5 WHEN 1 THEN 30.25 END", "41.5e0 WHEN 1 THEN 30.25e0 END"), ("rec_log",))
def top_matches(spark, sf):
    return entries(spark, sf).select("filename", F.inline("top_matches"))


@query("flat_export", f"""SELECT filename, CASE WHEN recognized THEN 'Yes' ELSE 'No' END AS recognized, person AS primary_person, CASE WHEN recognized THEN CASE k WHEN 0 THEN 'a ' || person ELSE person END END AS match_1_person, CASE WHEN recognized THEN confidence END AS match_1_confidence,
    CASE WHEN recognized AND k < 3 THEN CASE k WHEN 0 THEN replace(other, '_', ' ') ELSE other END END AS match_2_person, CASE WHEN recognized THEN CASE k WHEN 0 THEN 41.5e0 WHEN 1 THEN 30.25e0 END END AS match_2_confidence, coalesce(NULL, 'none') AS match_3_person, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CAST(l_linenumber AS BIGINT) AS face_count FROM ({TOP}) t""", ("rec_log",))
def flat_export(spark, sf):
    e = entries(spark, sf).withColumn("domain", F.lit("d")).withColumn("face_count", F.col("l_linenumber").cast("long")).withColumn("processing_time_ms", F.lit(1.0))
    return L.flat_export(e).select("filename", "recognized", "primary_person", "match_1_person", "match_1_confidence", "match_2_person", "match_2_confidence", F.coalesce("match_3_person", F.lit("none")).alias("match_3_person"), "timestamp", "face_count")


@query("result_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def result_page(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return L.page(o, order=[F.col("o_totalprice").desc(), "o_orderkey"], number=3, size=100)


@query("result_page_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 250")
def result_page_after(spark, sf):
    return L.page_after(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), key="o_orderkey", after=1000, size=250)


@query("newest_dates", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders ORDER BY 1 DESC LIMIT 30")
def newest_dates(spark, sf):
    d = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return L.newest_dates(d.unionByName(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("date"))))


@query("nested_statistics", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 2 WHEN event_id % 3 = 1 THEN event_id END AS frames FROM events")
def nested_statistics(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.to_json(F.struct(F.struct(F.struct((k * 2).alias("frames")).alias("statistics")).alias("face_recognition"), F.struct(F.lit(1).alias("frames")).alias("statistics")))).when(k % 3 == 1, F.to_json(F.struct(F.struct(k.alias("frames")).alias("statistics")))).otherwise(F.lit("{}"))
    r = F.from_json(text, "struct<face_recognition:struct<statistics:struct<frames:bigint>>,statistics:struct<frames:bigint>>")
    return e.select("event_id", S.statistics_of(r)["frames"].alias("frames"))


@query("json_columns", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type AS first_person FROM events")
def json_columns(spark, sf):
    e = table(spark, sf, "events").withColumn("persons", F.to_json(F.array(F.struct(F.col("event_type").alias("name"), F.col("value").alias("confidence")))))
    p = F.from_json("persons", "array<struct<name:string,confidence:double>>")
    return e.select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"), F.get(p, F.lit(0))["name"].alias("first_person"))


@query("elapsed", "SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-02-15 12:00:00') - epoch(ts)) / 86400) AS BIGINT) AS days, round((epoch(TIMESTAMP '2024-02-15 12:00:00') - epoch(ts)) / 3600, 4) AS hours, CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AS in_range FROM events")
def elapsed(spark, sf):
    e = table(spark, sf, "events")
    now = F.lit("2024-02-15 12:00:00").cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select("event_id", S.days_since(now, ts).alias("days"), F.round(S.hours_since(now, ts), 4).alias("hours"), S.in_days(F.col("ts"), "2024-01-05", "2024-01-09").alias("in_range"))
