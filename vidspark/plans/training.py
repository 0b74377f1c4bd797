"""One training cycle per as-of date: who is due, which references agree, which candidates enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.operators.common import numbered
from vidspark.operators.search import consensus, validate_against
from vidspark.operators.workflow import due_queue, queue_order, queue_state, stop_at_target


def training_queue(events: DataFrame, history: DataFrame, *, as_of: Column) -> DataFrame:
    """The queue in order, without those trained too recently."""
    return queue_order(due_queue(queue_state(events), history, as_of=as_of))


def collect_images(seeds: DataFrame, candidates: DataFrame, *, person: str, id: str = "vec_id", consensus_threshold: float = 0.50, accept_threshold: float = 0.50, min_consensus: int = 4, target: int = 40) -> DataFrame:
    """References by consensus among the seeds, then candidates in id order validated against them until
    the target is met. Persons without consensus get nothing."""
    refs = consensus(seeds, group=person, threshold=consensus_threshold, min_size=min_consensus, id=id)
    refs = numbered(refs.select(person, id, "embedding"), [person], [id], name="ref_idx").select(person, "ref_idx", "embedding")
    judged = validate_against(candidates, refs, on=person, id=id, threshold=accept_threshold)
    known = judged.join(refs.select(person).distinct(), person, "left_semi")
    return stop_at_target(known, group=person, seq=id, accepted="accepted", target=target)


def cycle_report(collected: DataFrame, *, person: str, minimum: int = 7) -> DataFrame:
    """Outcome per person: success needs `minimum` accepted images."""
    g = collected.groupBy(person).agg(F.count(F.lit(1)).alias("tried"), F.count_if("accepted").alias("accepted"))
    return g.withColumn("success", F.col("accepted") >= minimum)
