"""A/B comparison of two pipelines."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import view
from vidspark.operators import compare as C

V = ("runs_a", "runs_b")
CMP = """cmp AS (SELECT image_id, coalesce(a.ts, b.ts) AS ts, a.status AS status_a, b.status AS status_b, a.person AS person_a, b.person AS person_b, a.confidence AS ca, b.confidence AS cb, a.seconds AS sa, b.seconds AS sb, ground_truth,
        coalesce(a.status = 'success', false) AS oka, coalesce(b.status = 'success', false) AS okb FROM (SELECT * FROM runs_a WHERE status <> 'no_match' OR confidence > 60) a FULL OUTER JOIN runs_b b USING (image_id)),
    c AS (SELECT *, oka AND okb AS both_succeeded, NOT oka AND NOT okb AS both_failed, oka AND NOT okb AS only_a_succeeded, okb AND NOT oka AS only_b_succeeded, oka AND okb AND person_a IS NOT DISTINCT FROM person_b AS results_match,
        CASE WHEN oka AND okb THEN round(cb - ca, 2) END AS confidence_difference, CASE WHEN oka AND okb THEN round(sb - sa, 3) END AS time_difference,
        CASE WHEN oka AND okb AND sa IS NOT NULL AND sb IS NOT NULL THEN CASE WHEN sa < sb THEN 'pipeline_a' ELSE 'pipeline_b' END END AS faster,
        CASE WHEN ground_truth IS NOT NULL THEN oka AND person_a = ground_truth END AS a_correct, CASE WHEN ground_truth IS NOT NULL THEN okb AND person_b = ground_truth END AS b_correct FROM cmp),
    m AS (SELECT *, CASE WHEN ground_truth IS NULL THEN NULL WHEN a_correct AND NOT b_correct THEN 'pipeline_a' WHEN b_correct AND NOT a_correct THEN 'pipeline_b' WHEN a_correct AND b_correct THEN 'both' ELSE 'neither' END AS winner FROM c)"""
AGG = """count(*) AS total, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) FILTER (both_succeeded) AS both_succeeded, count(*) FILTER (both_failed) AS both_failed, count(*) FILTER (only_a_succeeded) AS only_a_succeeded, count(*) FILTER (only_b_succeeded) AS only_b_succeeded,
    round(count(*) FILTER (both_succeeded) / count(*) * 100, 2) AS both_succeeded_pct, round(count(*) FILTER (both_failed) / count(*) * 100, 2) AS both_failed_pct, round(count(*) FILTER (only_a_succeeded) / count(*) * 100, 2) AS only_a_succeeded_pct, round(count(*) FILTER (only_b_succeeded) / count(*) * 100, 2) AS only_b_succeeded_pct,
    count(*) FILTER (results_match) AS agreements, count(*) FILTER (both_succeeded) - count(*) FILTER (results_match) AS disagreements, coalesce(round(count(*) FILTER (results_match) / nullif(count(*) FILTER (both_succeeded), 0) * 100, 2), 0.0) AS agreement_rate,
    count(winner) AS with_truth, round(count(*) FILTER (a_correct) / nullif(count(winner), 0) * 100, 2) AS accuracy_a, round(count(*) FILTER (b_correct) / nullif(count(winner), 0) * 100, 2) AS accuracy_b, round((count(*) FILTER (b_correct) - count(*) FILTER (a_correct)) / nullif(count(winner), 0) * 100, 2) AS improvement,
    round(avg(confidence_difference), 2) AS avg_confidence_difference, round(avg(time_difference) * 1000, 2) AS avg_time_difference_ms, count(*) FILTER (faster = 'pipeline_b') AS b_faster, min(time_difference) AS min_time_difference, max(time_difference) AS max_time_difference"""


def compared(spark, sf):
    a, b = view(spark, sf, "runs_a"), view(spark, sf, "runs_b")
    a = a.filter("status <> 'no_match' OR confidence > 60")  # some images were never run by pipeline a
    return C.compare_runs(a.drop("ground_truth"), b, truth=a.select("image_id", "ground_truth"))


def _plain(df):
    """Means at a precision at which the order of summation cannot show."""
    stamp = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_ts", "last_ts")]
    return df.select(*[c for c in df.columns if c not in ("first_ts", "last_ts")], *stamp)


def _summary(cmp, **kw):
    """The operator's own columns; its two means are rounded on, to where the order of summation cannot show."""
    return _plain(C.comparison_summary(cmp, **kw))


@query("compare_runs", f"WITH {CMP} SELECT image_id, both_succeeded, both_failed, only_a_succeeded, only_b_succeeded, results_match, round(confidence_difference, 2) + 0.0 AS confidence_difference, round(time_difference, 3) + 0.0 AS time_difference, faster, a_correct, b_correct, winner FROM m", V)
def compare_runs(spark, sf):
    return compared(spark, sf).select("image_id", "both_succeeded", "both_failed", "only_a_succeeded", "only_b_succeeded", "results_match", (F.col("confidence_difference") + 0.0).alias("confidence_difference"), (F.col("time_difference") + 0.0).alias("time_difference"), "faster", "a_correct", "b_correct", "winner")


@query("comparison_summary", f"WITH {CMP} SELECT {AGG} FROM m", V)
def comparison_summary(spark, sf):
    return _summary(compared(spark, sf))


@query("comparison_range", f"WITH {CMP} SELECT total, agreements, with_truth, b_faster, first_ts, last_ts FROM (SELECT {AGG} FROM m WHERE ts >= TIMESTAMP '1995-03-01' AND ts < TIMESTAMP '1996-07-01') x", V)
def comparison_range(spark, sf):
    return _plain(C.comparison_summary(compared(spark, sf), start="1995-03-01", end="1996-06-30")).select("total", "agreements", "with_truth", "b_faster", "first_ts", "last_ts")


@query("daily_summary", f"WITH {CMP} SELECT strftime(ts, '%Y-%m-%d') AS day, total, both_succeeded, agreements, agreement_rate, with_truth, accuracy_a, accuracy_b, b_faster FROM (SELECT date_trunc('day', ts) AS ts, {AGG} FROM m GROUP BY 1) x", V)
def daily_summary(spark, sf):
    d = C.daily_summary(compared(spark, sf))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "both_succeeded", "agreements", "agreement_rate", "with_truth", "accuracy_a", "accuracy_b", "b_faster")


@query("weekly_summary", f"WITH {CMP}, w AS (SELECT m.*, CAST(ts AS DATE) - CAST(unnest([0, 1, 2, 3, 4, 5, 6]) AS INTEGER) AS week FROM m) SELECT strftime(week, '%Y-%m-%d') AS week, total, both_failed, agreements, agreement_rate, accuracy_b, improvement FROM (SELECT week, {AGG} FROM w GROUP BY 1) x", V)
def weekly_summary(spark, sf):
    w = C.weekly_summary(compared(spark, sf))
    return w.select(F.date_format("week.start", "yyyy-MM-dd").alias("week"), "total", "both_failed", "agreements", "agreement_rate", "accuracy_b", "improvement")


@query("recommendations", f"""WITH {CMP}, s AS (SELECT date_trunc('month', ts) AS mon, {AGG.replace("time_difference) * 1000, 1)", "time_difference) * 1000, 2)")} FROM m GROUP BY 1)
    SELECT strftime(mon, '%Y-%m') AS month, coalesce(nullif(concat_ws(' | ', CASE WHEN improvement > 10 THEN printf('strong: b is %.2f%% more accurate, consider migration', improvement) WHEN improvement > 5 THEN printf('b is %.2f%% more accurate, continue testing', improvement)
        WHEN improvement > 0 THEN printf('b is slightly more accurate (%.2f%%), collect more data', improvement) WHEN improvement < -5 THEN printf('warning: b is %.2f%% less accurate, review configuration', abs(improvement)) END,
        CASE WHEN only_b_succeeded_pct > only_a_succeeded_pct + 10 THEN printf('b succeeds where a does not (%.2f%% vs %.2f%%)', only_b_succeeded_pct, only_a_succeeded_pct) WHEN only_a_succeeded_pct > only_b_succeeded_pct + 10 THEN printf('a succeeds where b does not (%.2f%% vs %.2f%%), investigate', only_a_succeeded_pct, only_b_succeeded_pct) END,
        CASE WHEN agreement_rate > 90 THEN printf('high agreement (%.2f%%)', agreement_rate) WHEN agreement_rate < 70 THEN printf('low agreement (%.2f%%), review disagreements', agreement_rate) END,
        CASE WHEN avg_time_difference_ms < -100 THEN printf('b is %.0f ms faster', abs(avg_time_difference_ms)) WHEN avg_time_difference_ms > 500 THEN printf('b is %.0f ms slower', avg_time_difference_ms) END), ''), 'continue collecting data') AS advice FROM s""", V)
def recommendations(spark, sf):
    m = C.comparison_summary(compared(spark, sf), by=[F.date_format("ts", "yyyy-MM").alias("month")])
    return m.select("month", F.array_join(C.recommendations(), " | ").alias("advice"))


@query("image_advice", f"""WITH {CMP} SELECT image_id, CASE WHEN both_failed THEN 'both failed, check image quality' WHEN only_b_succeeded THEN 'only b found a match' WHEN only_a_succeeded THEN 'only a found a match, review b'
    WHEN results_match AND coalesce(confidence_difference, 0) > 5 THEN 'both agree, b more confident' WHEN results_match AND coalesce(confidence_difference, 0) < -5 THEN 'both agree, a more confident' WHEN results_match THEN 'both agree, similar confidence' ELSE 'pipelines disagree, review by hand' END AS advice FROM m""", V)
def image_advice(spark, sf):
    return compared(spark, sf).select("image_id", C.image_advice().alias("advice"))


@query("metric_trend", f"""WITH {CMP}, d AS (SELECT CAST(ts AS DATE) AS day, {AGG.split(', min(time_difference)')[0]} FROM m GROUP BY 1), s AS (SELECT day, 'accuracy_b' AS metric, accuracy_b AS v FROM d UNION ALL SELECT day, 'agreement_rate', agreement_rate FROM d UNION ALL SELECT day, 'b_faster', CAST(b_faster AS DOUBLE) FROM d)
    SELECT metric, count(*) AS days, round(regr_slope(v, CAST(day - DATE '1970-01-01' AS DOUBLE)), 6) + 0.0 AS slope, arg_min(v, day) AS first_value, arg_max(v, day) AS last_value FROM s WHERE v IS NOT NULL GROUP BY 1""", V)
def metric_trend(spark, sf):
    t = C.metric_trend(C.daily_summary(compared(spark, sf)), metrics=("accuracy_b", "agreement_rate", "b_faster"))
    return t.select("metric", "days", (F.round("slope", 6) + 0.0).alias("slope"), "first_value", "last_value")


@query("confusion_rates", f"""WITH {CMP} SELECT count(winner) AS known, round(count(*) FILTER (b_correct) / count(winner) * 100, 4) AS accuracy, round(count(*) FILTER (okb AND winner IS NOT NULL AND NOT b_correct) / count(winner) * 100, 4) AS false_positive_rate,
    round(count(*) FILTER (NOT okb AND winner IS NOT NULL) / count(winner) * 100, 4) AS false_negative_rate, round(count(*) FILTER (b_correct) / count(winner) * 40.0e0 + 25 * (1 - count(*) FILTER (okb AND winner IS NOT NULL AND NOT b_correct) / count(winner)) + 35, 3) AS score FROM m""", V)
def confusion_rates(spark, sf):
    r = C.confusion_rates(compared(spark, sf))
    full = F.lit(100.0)
    scored = r.select("*", r["false_positive_rate"].alias("fp")).withColumn("false_positives", 100 - F.col("fp")).withColumn("speed", full).withColumn("coverage", full).withColumn("stability", full)
    return scored.select("known", "accuracy", "false_positive_rate", "false_negative_rate", F.round(C.scorecard(scored), 3).alias("score"))
