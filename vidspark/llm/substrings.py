"""Repeated spans of at least `window` words, by compaction of a de Bruijn graph over words.

Edges of the graph are the k-mers of k = `window` words; an edge is repeated if it occurs in two or more
documents. Not every edge has to be written out to find those:

1. Anchors. Of the shorter k-mers of `anchor` words the ones with the lowest hash among the
   `window - anchor + 1` in some window are kept (about one word in sixteen). Equal windows have equal
   anchors, so a window whose anchor is in one document only is no repeated edge.
2. Edges. Documents with repeated anchors write out the edges around those, packed: consecutive edges with
   one anchor are a nonbranching stretch and make one row, with a 128-bit hash of the stretch and the
   hashes of its edges (64 and 32 bits). Equal stretches meet first: a grouped minimum gives each its
   first source coordinate, and all edges of a later document's stretch are settled by a join. Only
   where an anchor has several different stretches, at the ends of a repeat, are the edges of the first
   stretches unpacked, and the same minimum and join taken edge by edge.
3. Compaction. Marked edges of a document that follow each other and lead to the same earlier document at
   the same distance lie on one path; each path becomes one span with both coordinates.

Removed are the words covered by a span, judged on the input. Spans are exact: a path holds every window
that starts in a document with a smaller id and no other.

Defined results: a null text has no word; null ids rank behind all others; documents are told apart by
id and text, so repeated rows get equal results and do not remove each other, nor do different texts of
one id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.llm.text import only
from vidspark.session import cut_lineage, stored

WINDOW, ANCHOR = 50, 20
#: Odd bases of the two window hashes, and the mixing constants.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(text: bytes) -> tuple[list[bytes], np.ndarray]:
    from xxhash import xxh64_intdigest

    words = text.split()
    return words, np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Mixed polynomial hash, modulo 2^64, of every run of `width` words: differences of prefix sums,
    brought to one power by the inverse of the base."""
    n = len(hashes)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    power, inverse = np.full(n, base, dtype=np.uint64), np.full(n - width + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    power[0] = inverse[0] = 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * np.cumprod(power), dtype=np.uint64)))
    return mixed((sums[width:] - sums[:-width]) * np.cumprod(inverse))


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Lowest (highest) of every `width` neighbours, by doubling."""
    best = np.minimum if least else np.maximum
    span, out = 1, values
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor (lowest k-mer hash) of every window."""
    grams = rolling(hashes, anchor, BASES[0])
    return sliding(grams, window - anchor + 1) if len(hashes) >= window else np.empty(0, dtype=np.uint64)


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Per document its distinct anchors, and the digest of its words joined by one space."""
    for batch in batches:
        words, digests, found = [], [], []
        for value in batch.column("_text"):
            w, hashes = word_hashes((value.as_py() or "").encode())
            words.append(len(w))
            digests.append(hashlib.sha256(b" ".join(w)).hexdigest())
            found.append(np.unique(window_anchors(hashes, window, anchor)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(words, pa.int64()), pa.array(digests), pa.array(found, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "n_words", "sha256", "anchors"],
        )


def _stretches(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The windows of each document whose anchor is among its repeated ones, packed by anchor."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        for k in range(batch.num_rows):
            _, hashes = word_hashes((batch.column("_text")[k].as_py() or "").encode())
            repeated = batch.column("repeated").slice(k, 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            marks = window_anchors(hashes, window, anchor)
            at = np.flatnonzero(np.isin(marks, repeated))
            if not at.size:
                continue
            high, low = (rolling(hashes, window, b)[at] for b in BASES)
            low = low.astype(np.uint32)
            marks = marks[at]
            first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (marks[1:] != marks[:-1])])
            ends = np.r_[first[1:], at.size]
            whole = np.frombuffer(b"".join(xxh3_128_digest(high[x:y].tobytes() + low[x:y].tobytes()) for x, y in zip(first.tolist(), ends.tolist(), strict=True)), dtype=np.int64).reshape(-1, 2)
            rows, cuts = pa.array(np.full(first.size, k)), pa.array(np.r_[first, at.size].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(marks[first].view(np.int64)), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()),
                    pa.array(at[first].astype(np.int32)), pa.array((ends - first).astype(np.int32)),
                    pa.ListArray.from_arrays(cuts, pa.array(high.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(low.view(np.int32))),
                ],
                names=["doc_id", "text_hash", "mark", "one", "two", "start", "edges", "high", "low"],
            )


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of documents with spans to remove."""
    for batch in batches:
        removed, digests = [], []
        for k in range(batch.num_rows):
            words = (batch.column("_text")[k].as_py() or "").encode().split()
            keep = np.ones(len(words), dtype=bool)
            for span in batch.column("spans")[k].as_py():
                keep[span["start"] : span["end"]] = False
            removed.append(int(len(words) - keep.sum()))
            digests.append(hashlib.sha256(b" ".join([w for w, stays in zip(words, keep, strict=True) if stays])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "text_hash", "n_removed", "sha256"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, doc_id=id_col, _text=text_col).select("doc_id", F.xxhash64("_text").alias("text_hash"), "_text")


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the document: id (null equals null) and text hash."""
    b = b.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_hash", "_h")
    return a.join(b, (a["text_hash"] == b["_h"]) & a["doc_id"].eqNullSafe(b["_d"]), how).drop("_d", "_h")


def _rank():
    """Documents in order: known ids by size, then unknown ones."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"))


def repeated_spans(docs: DataFrame, profile: DataFrame, *, window: int, anchor: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, start, end (words, end exclusive), source_id, source_start: the paths of repeated
    edges in documents behind another that has them. `profile`: as `_anchors` gives it."""
    kinds = f"doc_id {profile.schema['doc_id'].dataType.simpleString()}, text_hash long"
    marks = profile.select("doc_id", "text_hash", F.explode("anchors").alias("mark"))
    shared = marks.groupBy("mark").agg(F.min(_rank()).alias("low"), F.max(_rank()).alias("high")).filter("low <> high").select("mark")
    repeated = marks.join(shared, "mark").groupBy("doc_id", "text_hash").agg(F.collect_set("mark").alias("repeated"))
    packed = _same(_texts(docs, id_col, text_col), repeated).mapInArrow(
        partial(_stretches, window=window, anchor=anchor), f"{kinds}, mark long, one long, two long, start int, edges int, high array<long>, low array<int>")
    packed = stored(packed)
    whole = packed.select("doc_id", "text_hash", "mark", "one", "two", "start", "edges").distinct()  # repeated rows
    # equal stretches, and which anchors have several
    source = whole.groupBy("mark", "one", "two").agg(F.min(F.struct(_rank().alias("rank"), F.col("start"))).alias("source"), F.count(F.lit(1)).alias("n"))
    source = stored(source.select("mark", "one", "two", F.col("source.rank").alias("source_rank"), F.col("source.start").alias("source_start"), "n"))
    settled = whole.join(source.filter("n > 1").drop("n"), ["mark", "one", "two"]).filter(_rank() > F.col("source_rank"))
    settled = settled.select("doc_id", "text_hash", "start", "edges", F.col("source_rank.doc_id").alias("source_id"), "source_start")
    several = source.groupBy("mark").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("mark")
    first = packed.join(source.join(several, "mark", "left_semi").select("mark", "one", "two", "source_rank"), ["mark", "one", "two"]).filter(_rank() == F.col("source_rank"))
    single = first.select("doc_id", "text_hash", F.explode(F.transform("high", lambda h, i: F.struct(h.alias("high"), F.get(F.col("low"), i).alias("low"), (F.col("start") + i).alias("start")))).alias("e")).select("doc_id", "text_hash", "e.*")
    single = stored(single)
    earlier = single.groupBy("high", "low").agg(F.min(F.struct(_rank().alias("rank"), F.col("start"))).alias("source"), F.max(_rank()).alias("last")).filter("source.rank <> last")
    earlier = earlier.select("high", "low", F.col("source.rank").alias("source_rank"), F.col("source.start").alias("source_start"))
    ends = single.join(earlier, ["high", "low"]).filter(_rank() > F.col("source_rank"))
    ends = ends.select("doc_id", "text_hash", "start", F.lit(1).alias("edges"), F.col("source_rank.doc_id").alias("source_id"), "source_start").distinct()
    # compaction: one run per row of stretches that follow each other, with one source and one distance to it
    document = W.partitionBy("doc_id", "text_hash").orderBy("start")
    width = F.lag("edges").over(document)
    joins_on = (F.lag("start").over(document) + width == F.col("start")) & F.lag("source_id").over(document).eqNullSafe(F.col("source_id")) & (F.lag("source_start").over(document) + width == F.col("source_start"))
    runs = settled.unionByName(ends).withColumn("_new", F.when(F.coalesce(joins_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(document))
    return runs.groupBy("doc_id", "text_hash", "_run").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("edges")) + window - 1).alias("end"), F.first("source_id").alias("source_id"), F.min("source_start").alias("source_start"),
    ).drop("_run")


def without_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    texts = _texts(docs, id_col, text_col)
    kinds = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_hash long"
    profile = stored(texts.mapInArrow(partial(_anchors, window=window, anchor=anchor), f"{kinds}, n_words long, sha256 string, anchors array<long>"))
    spans = repeated_spans(docs, profile, window=window, anchor=anchor, id_col=id_col, text_col=text_col)
    per = cut_lineage(spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    cut = _same(texts, per).mapInArrow(_rest, f"{kinds}, n_removed long, sha256 string").distinct().withColumnRenamed("sha256", "_cut")
    out = _same(profile.select("doc_id", "text_hash", "n_words", "sha256"), cut, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_cut", "sha256").alias("kept_sha256"))
