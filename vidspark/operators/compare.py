"""Two matching pipelines over the same images: per-image comparison, summaries, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.functions.scalars import in_days
from vidspark.operators.common import pct

RUN_FIELDS = ("status", "person", "confidence", "seconds")


def compare_runs(a: DataFrame, b: DataFrame, *, on: str = "image_id", truth: DataFrame | None = None) -> DataFrame:
    """Full outer join of two run tables (on, ts, status, person, confidence, seconds) with metrics per
    image. A tie in time counts for pipeline b."""

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(on, F.col("ts").alias(f"_ts_{s}"), *[(F.col(c) if c in ("status", "person") else F.col(c).cast("double")).alias(f"{c}_{s}") for c in RUN_FIELDS])

    both = side(a, "a").join(side(b, "b"), on, "full_outer").withColumn("ts", F.coalesce("_ts_a", "_ts_b")).drop("_ts_a", "_ts_b")
    both = both.join(truth, on, "left") if truth is not None else both.withColumn("ground_truth", F.lit(None).cast("string"))
    return both.select("*", *comparison_metrics())


def comparison_metrics() -> list[Column]:
    ok_a, ok_b = (F.coalesce(F.col(f"status_{s}") == "success", F.lit(False)) for s in "ab")
    both = ok_a & ok_b
    faster = F.when(F.col("seconds_a") < F.col("seconds_b"), "pipeline_a").otherwise("pipeline_b")
    timed = F.col("seconds_a").isNotNull() & F.col("seconds_b").isNotNull()
    has_truth = F.coalesce(F.col("ground_truth") != "", F.lit(False))
    right_a, right_b = (ok & F.expr(f"person_{s} <=> ground_truth") for s, ok in (("a", ok_a), ("b", ok_b)))
    winner = F.when(right_a & ~right_b, "pipeline_a").when(right_b & ~right_a, "pipeline_b").when(right_a & right_b, "both").otherwise("neither")
    return [
        both.alias("both_succeeded"), (~ok_a & ~ok_b).alias("both_failed"), (ok_a & ~ok_b).alias("only_a_succeeded"), (ok_b & ~ok_a).alias("only_b_succeeded"),
        (both & F.expr("person_a <=> person_b")).alias("results_match"),
        F.when(both, F.round(F.col("confidence_b") - F.col("confidence_a"), 2)).alias("confidence_difference"),
        F.when(both, F.round(F.col("seconds_b") - F.col("seconds_a"), 3)).alias("time_difference"),
        F.when(both & timed, faster).alias("faster"),
        F.when(has_truth, right_a).alias("a_correct"), F.when(has_truth, right_b).alias("b_correct"), F.when(has_truth, winner).alias("winner"),
    ]


#: Parts of the metrics that add up, are least or are largest, over any set of rows.
_COUNTED = ("both_succeeded", "both_failed", "only_a_succeeded", "only_b_succeeded", "results_match", "a_correct", "b_correct")
_MEANS = ("confidence_difference", "time_difference")
_SUMS = ("total", "with_truth", "b_faster", *(f"n_{c}" for c in _COUNTED), *(f"{k}_{c}" for c in _MEANS for k in ("n", "s")))


def partial_metrics() -> list[Column]:
    """The mergeable state of a set of compared images."""
    return [
        F.count(F.lit(1)).alias("total"), F.count("winner").alias("with_truth"), F.count_if(F.col("faster") == "pipeline_b").alias("b_faster"),
        *[F.count_if(c).alias(f"n_{c}") for c in _COUNTED],
        *[x for c in _MEANS for x in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"))],
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("time_difference").alias("min_time_difference"), F.max("time_difference").alias("max_time_difference"),
    ]


def merged_metrics() -> list[Column]:
    """State of several states."""
    return [F.sum(c).alias(c) for c in _SUMS] + [f(c).alias(c) for f, c in ((F.min, "first_ts"), (F.max, "last_ts"), (F.min, "min_time_difference"), (F.max, "max_time_difference"))]


def finished_metrics() -> list[Column]:
    """The metrics of a state."""
    n, both, known = F.col("total"), F.col("n_both_succeeded"), F.col("with_truth")
    mean = lambda c: F.when(F.col(f"n_{c}") > 0, F.col(f"s_{c}") / F.col(f"n_{c}"))
    shown = _COUNTED[:4]
    return [
        n.alias("total"), F.col("first_ts"), F.col("last_ts"), *[F.col(f"n_{c}").alias(c) for c in shown], *[pct(F.col(f"n_{c}"), n).alias(f"{c}_pct") for c in shown],
        F.col("n_results_match").alias("agreements"), (both - F.col("n_results_match")).alias("disagreements"),
        F.coalesce(pct(F.col("n_results_match"), both), F.lit(0.0)).alias("agreement_rate"),
        known.alias("with_truth"), pct(F.col("n_a_correct"), known).alias("accuracy_a"), pct(F.col("n_b_correct"), known).alias("accuracy_b"),
        pct(F.col("n_b_correct") - F.col("n_a_correct"), known).alias("improvement"),
        F.round(mean("confidence_difference"), 2).alias("avg_confidence_difference"), F.round(mean("time_difference") * 1000, 2).alias("avg_time_difference_ms"),
        F.col("b_faster"), F.col("min_time_difference"), F.col("max_time_difference"),
    ]


def comparison_summary(cmp: DataFrame, *, by: Sequence[str | Column] = (), start: str | None = None, end: str | None = None, ids: DataFrame | None = None, on: str = "image_id") -> DataFrame:
    """Counts, agreement, accuracy and mean differences; per group, date range or id list."""
    if start or end:
        cmp = cmp.filter(in_days(F.col("ts"), start or "0001-01-01", end or "9999-12-30"))
    if ids is not None:
        cmp = cmp.join(ids.select(on).distinct(), on, "left_semi")
    state = cmp.groupBy(*by).agg(*partial_metrics())
    return state.select(*[c for c in state.columns if c not in {x for m in (_SUMS, ("first_ts", "last_ts", "min_time_difference", "max_time_difference")) for x in m}], *finished_metrics())


def daily_summary(cmp: DataFrame) -> DataFrame:
    return comparison_summary(cmp, by=[F.to_date("ts").alias("day")])


def weekly_summary(cmp: DataFrame, *, days: int = 7, slide: int = 1) -> DataFrame:
    """Sliding windows of `days`, one per `slide` days, from panes of `slide` days: each row is counted once,
    and only the state of a pane goes to all windows that it lies in."""
    if days % slide:
        return comparison_summary(cmp, by=[F.window(F.col("ts").cast("timestamp"), f"{days} days", f"{slide} days").alias("week")])
    panes = cmp.groupBy(F.window(F.col("ts").cast("timestamp"), f"{slide} days").alias("_pane")).agg(*partial_metrics())
    back = F.explode(F.sequence(F.lit(0), F.lit(days // slide - 1))).alias("_back")
    placed = panes.filter("_pane IS NOT NULL").select("*", back).withColumn("_start", F.expr(f"_pane.start - make_dt_interval(_back * {slide})"))
    weeks = placed.groupBy("_start").agg(*merged_metrics())
    return weeks.select(F.struct(F.col("_start").alias("start"), (F.col("_start") + F.expr(f"make_dt_interval({days})")).alias("end")).alias("week"), *finished_metrics())


def recommendations() -> Column:
    """Advice derived from a summary row, as an array of texts."""
    imp, agree, ms = F.col("improvement"), F.col("agreement_rate"), F.col("avg_time_difference_ms")
    a, b = F.col("only_a_succeeded_pct"), F.col("only_b_succeeded_pct")
    rules = [
        F.when(imp > 10, F.format_string("strong: b is %.2f%% more accurate, consider migration", imp))
        .when(imp > 5, F.format_string("b is %.2f%% more accurate, continue testing", imp))
        .when(imp > 0, F.format_string("b is slightly more accurate (%.2f%%), collect more data", imp))
        .when(imp < -5, F.format_string("warning: b is %.2f%% less accurate, review configuration", F.abs(imp))),
        F.when(b > a + 10, F.format_string("b succeeds where a does not (%.2f%% vs %.2f%%)", b, a))
        .when(a > b + 10, F.format_string("a succeeds where b does not (%.2f%% vs %.2f%%), investigate", a, b)),
        F.when(agree > 90, F.format_string("high agreement (%.2f%%)", agree)).when(agree < 70, F.format_string("low agreement (%.2f%%), review disagreements", agree)),
        F.when(ms < -100, F.format_string("b is %.0f ms faster", F.bround(F.abs(ms), 0))).when(ms > 500, F.format_string("b is %.0f ms slower", F.bround(ms, 0))),
    ]
    found = F.array_compact(F.array(*rules))
    return F.when(F.size(found) == 0, F.array(F.lit("continue collecting data"))).otherwise(found)


def image_advice() -> Column:
    """One sentence per compared image."""
    d = F.coalesce("confidence_difference", F.lit(0.0))
    return (
        F.when(F.col("both_failed"), "both failed, check image quality")
        .when(F.col("only_b_succeeded"), "only b found a match")
        .when(F.col("only_a_succeeded"), "only a found a match, review b")
        .when(F.col("results_match") & (d > 5), "both agree, b more confident")
        .when(F.col("results_match") & (d < -5), "both agree, a more confident")
        .when(F.col("results_match"), "both agree, similar confidence")
        .otherwise("pipelines disagree, review by hand")
    )


def metric_trend(daily: DataFrame, *, day: str = "day", metrics: Sequence[str] = ("accuracy_b", "agreement_rate", "avg_time_difference_ms")) -> DataFrame:
    """Slope per day of each daily metric over the whole range, with its first and last value. The
    reference only names this report; the computation is ours."""
    x = F.date_diff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")
    stacked = daily.select(day, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))).filter("value IS NOT NULL")
    return stacked.groupBy("metric").agg(
        F.count(F.lit(1)).alias("days"), F.regr_slope("value", x).alias("slope"), F.min_by("value", day).alias("first_value"), F.max_by("value", day).alias("last_value")
    )


def confusion_rates(cmp: DataFrame, *, side: str = "b") -> DataFrame:
    """Accuracy, false-positive and false-negative rate against the known labels."""
    ok = F.coalesce(F.col(f"status_{side}") == "success", F.lit(False))
    right = F.col(f"{side}_correct")
    known = F.count("winner")
    return cmp.agg(
        known.alias("known"), pct(F.count_if(right), known, 4).alias("accuracy"),
        pct(F.count_if(ok & F.col("winner").isNotNull() & ~right), known, 4).alias("false_positive_rate"),
        pct(F.count_if(~ok & F.col("winner").isNotNull()), known, 4).alias("false_negative_rate"),
    )


# Weights of the decision scorecard.
SCORECARD = {"accuracy": 0.40, "false_positives": 0.25, "speed": 0.20, "coverage": 0.10, "stability": 0.05}


def scorecard(scores: DataFrame) -> Column:
    """Weighted sum of five 0-100 scores held in columns of these names."""
    total = F.lit(0.0)
    for name, weight in SCORECARD.items():
        total = total + F.col(name) * weight
    return total
