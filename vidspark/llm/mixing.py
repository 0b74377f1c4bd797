"""Mixing sources to target weights by Pareto order sampling.

Targets share a budget of words by source weight and stop at `cap` times a source's own size; what is
cut off is shared again by weight (solved at once: sources in order of size per weight fill up first).
A source with target T and size S gives every document floor(T / S) certain whole copies. The rest R is
a sample of further copies: a document has inclusion odds pi / (1 - pi) with pi proportional to the
square root of its size (expected words R), random odds U / (1 - U), and the rank q = random odds /
inclusion odds; documents whose pi reaches 1 are certain and stand first, in random order. The sample is
read off that order: a document is taken if it fits into what is left of R and passed over otherwise, so
at the end every document outside is larger than what is left. If the smallest of those comes nearer to
R than stopping does, it is taken too: a source misses its target by at most half of that document.

The order is never sorted as a whole: words that can fit are summed per source and bucket of q, only the
one bucket in which the budget ends is ordered, and behind the document that did not fit the sums go on
with those that fit into the smaller rest. Each pass either ends a source or lowers what is left below
the size of the document passed over, so passes grow with the logarithm of sizes, not with rows. The
outcome is one row per source with the stretches of the order it takes; whether a document is taken
follows from that row and the document alone. U comes from the md5 of the id, so reruns agree.

Defined results: null texts have size 0 and are never taken; a null source is a source of its own, last
in order; null ids count as ''; repeated rows (same id, size and source) share one decision and fit together or not at all; an empty
table gives an empty result; other columns are carried (`mixed_documents`) or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.llm.text import only, trimmed, word_count
from vidspark.session import cut_lineage

BUCKETS = 4096
#: Sources up to which their table is broadcast (a few hundred bytes each).
BROADCAST_SOURCES = 20_000


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the md5 of a string."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    rows = only(docs, doc_id=id_col, source=source_col, _text=text_col)
    return rows.select("doc_id", "source", word_count(trimmed(F.col("_text"))).alias("size"))


def targets(rows: DataFrame, *, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: source, source_size, target. Windows here run over sources, not rows."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(_scale(F.col("size")) * F.col("size").cast("decimal(20,0)")).alias("_moment"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_full", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("_full") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, rest, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    per = per.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") < F.col("_full") / F.col("_weight"), F.col("_level"))).over(every))
    return per.withColumn("target", F.coalesce(F.least("_full", F.col("_level") * F.col("_weight")), F.col("_full"))).select("source", "source_size", "_moment", "target")


def _scale(size: Column) -> Column:
    """Square root of the size in 1/1024, as a whole number: sums of it do not depend on their order."""
    return F.floor(F.sqrt(size.cast("double")) * 1024).cast("decimal(20,0)")


def _ranked(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """`rows` with the columns of their source and `_at`, the place (rank, id, size) in its order; null
    where nothing is sampled. Ranks of certain documents are negative."""
    u = uniform(F.col("_key"))
    pi = F.col("_rest") / F.col("source_size") * _scale(F.col("size")).cast("double") / F.col("_mean")
    q = F.when(pi >= 1, u - 1).otherwise((u / (1 - u)) / (pi / (1 - pi)))
    out = _with_source(rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), sources, small)
    return out.withColumn("_at", F.when((F.col("size") > 0) & (F.col("_rest") > 0), F.struct(q.alias("q"), F.col("_key").alias("key"), F.col("size").alias("size"))))


def _with_source(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    side = sources.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def plan(rows: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, bool]:
    """(one row per source: sizes, target, certain copies, the stretches of its order that are sampled, the
    closing document; whether that table may be broadcast). `rows`: doc_id, source, size, best read from a
    cut lineage."""
    sources = targets(rows, weights=weights, share=share, cap=cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("_copies", copies).withColumn("_rest", F.col("target") - F.col("_copies") * F.col("source_size"))
    sources = cut_lineage(sources.withColumn("_mean", F.when(F.col("source_size") > 0, F.col("_moment").cast("double") / F.col("source_size"))).drop("_moment"))
    small = sources.count() <= BROADCAST_SOURCES
    ranked = _ranked(rows, sources, small).filter("_at is not null").select("source", "size", "_at")
    at = ranked.schema["_at"].dataType.simpleString()
    state = sources.select(
        "source", F.col("_rest").alias("_left"), F.lit(None).cast(at).alias("_after"), (F.col("_rest") > 0).alias("_open"),
        F.array().cast(f"array<struct<after:{at},before:{at},most:double>>").alias("_parts"),
    )
    while True:
        state = cut_lineage(_passed(ranked, state, small))
        if state.filter("_open").isEmpty():
            break
    left = F.col("_left")
    outside = _with_source(ranked, state.select("source", "_left", "_parts"), small).filter(~_sampled() & (F.col("size") > left) & (F.col("size") - left < left))
    closing = outside.groupBy(F.col("source").alias("_s")).agg(F.min_by("_at", F.struct("size", "_at")).alias("_closing"))
    whole = _beside(_beside(sources, state.select(F.col("source").alias("_s"), "_parts")), closing)
    return cut_lineage(whole), small


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _passed(ranked: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """`state` after one pass: every open source takes what fits in order up to the first document that
    does not, and stays open behind it; a source without such a document is done."""
    going = state.filter("_open").select("source", "_left", "_after")
    rows = _with_source(ranked, going, small).filter((F.col("_after").isNull() | (F.col("_at") > F.col("_after"))) & (F.col("size") <= F.col("_left")))
    q = F.col("_at.q")
    rows = rows.withColumn("_bucket", F.floor(F.when(q < 0, q * BUCKETS).otherwise(q / (1 + q) * BUCKETS)))
    # where the rest ends: by bucket, then inside that bucket
    sums = rows.groupBy("source", "_bucket", "_left").agg(F.sum("size").alias("_words"), F.min("size").alias("_least"))
    upto = F.sum("_words").over(W.partitionBy("source").orderBy("_bucket"))
    ends = sums.withColumn("_upto", upto).groupBy("source").agg(
        F.min(F.when(F.col("_upto") > F.col("_left"), F.col("_bucket"))).alias("_end"),
        F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_left"), F.col("_upto"))), F.lit(0)).alias("_taken"), F.min("_least").alias("_least"),
    )
    ends = cut_lineage(ends)
    inside = F.col("_taken") + F.sum("size").over(W.partitionBy("source").orderBy("_at"))
    last = _with_source(rows, ends.filter("_end is not null"), small).filter("_bucket = _end").withColumn("_upto", inside)
    cut = last.groupBy(F.col("source").alias("_s")).agg(
        F.min(F.when(F.col("_upto") > F.col("_left"), F.col("_at"))).alias("_before"),
        F.max(F.when(F.col("_upto") <= F.col("_left"), F.col("_upto"))).alias("_more"),
    )
    new = _beside(_beside(state, ends.select(F.col("source").alias("_s"), "_taken", "_least")), cut)
    part = F.struct(F.col("_after").alias("after"), F.col("_before").alias("before"), F.col("_left").alias("most"))
    rest = F.col("_left") - F.coalesce("_more", "_taken", F.lit(0))
    return new.select(
        "source", F.when(F.col("_open"), rest).otherwise(F.col("_left")).alias("_left"), F.col("_before").alias("_after"),
        F.coalesce(F.col("_before").isNotNull() & (rest >= F.col("_least")), F.lit(False)).alias("_open"),
        F.when(F.col("_taken").isNotNull(), F.concat("_parts", F.array(part))).otherwise(F.col("_parts")).alias("_parts"),
    )


def _sampled() -> Column:
    """In one of the stretches, and of a size that was still considered there."""
    at = F.col("_at")
    return F.exists("_parts", lambda p: (p["after"].isNull() | (at > p["after"])) & (p["before"].isNull() | (at < p["before"])) & (at["size"] <= p["most"]))


def with_copies(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """`rows` (doc_id, source, size and any more) with source_size, target and copies."""
    out = _ranked(rows, sources, small)
    extra = F.coalesce(F.col("_at").isNotNull() & (_sampled() | F.coalesce(F.col("_at") == F.col("_closing"), F.lit(False))), F.lit(False))
    return out.withColumn("copies", F.when(F.col("size") > 0, F.col("_copies") + extra.cast("long")).otherwise(F.lit(0).cast("long"))).select(*rows.columns, "source_size", "target", "copies")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies of every row."""
    rows = cut_lineage(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    out = with_copies(rows, *plan(rows, **shares))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; the text is read again, not joined back."""
    rows = cut_lineage(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    sources, small = plan(rows, **shares)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(trimmed(F.col(f"`{text_col}`"))).alias("size"))
    out = with_copies(held, sources, small).filter("copies > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_doc.*")
