"""Groups of linked ids, and where chains of merges end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.session import cut_lineage


def connected_groups(links: DataFrame, *, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, root) with the lowest id of each connected group, by alternating large-star and
    small-star steps: a logarithmic number of rounds, each with partial minima before its shuffle and
    a reliable checkpoint after it. Convergence is judged by one aggregate row."""
    nodes = links.select(F.col(a).alias("id")).unionByName(links.select(F.col(b).alias("id"))).distinct()
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        edges = cut_lineage(_small_star(_large_star(edges)))
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("connected_groups did not converge")
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def resolve_merges(decisions: DataFrame, *, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Final target of every merged id: the member of its group that is merged into nothing; in a
    cycle, the lowest id."""
    groups = connected_groups(decisions, a=source, b=target)
    ends = groups.join(decisions.select(F.col(source).alias("id")).distinct(), "id", "left_anti")
    final = groups.groupBy("root").agg(F.min("id").alias("_low")).join(ends.groupBy("root").agg(F.min("id").alias("_end")), "root", "left")
    out = groups.join(final.select("root", F.coalesce("_end", "_low").alias("final_id")), "root")
    return out.filter("id <> final_id").select(F.col("id").alias(source), F.col("final_id").alias(target))
