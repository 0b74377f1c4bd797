"""Documents drawn by their likeness to a target collection, in proportion to importance weights.

Features are runs of consecutive words, hashed into buckets. Counts of both collections are pre-aggregated
to one array of `buckets` numbers a task; the gains of all buckets are one array too (both bounded by the
number of buckets, whatever the data), with which every document is scored where it is read. Random numbers
from the id turn weights into scores whose highest are the draw, and `radix_sort` ranks them.

Words: letters and digits, A-Z lower-cased, other characters of ASCII part them; all other characters count
as letters. Defined results: null and empty texts have no feature, weight 0 and no rank; a null id counts as
an empty one in the random number and ranks behind the others; repeated rows are drawn each, and of rows
equal in score and id those with fewer features, then lower weight come first; very long texts are read
whole, in one task each; an empty target has gains from the documents alone; an empty table gives an empty
result; further columns, whatever they are called, are ignored or, by `drawn_documents`, carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vidspark.llm.radix_sort import ranked
from vidspark.llm.text import only
from vidspark.session import stored

BUCKETS, RUN, SEED, LEAST, SHARE = 10_000, 2, 7, 20, 25
#: Words a worker remembers with their hash.
REMEMBERED = 500_000

#: Bytes of a text as they count: A-Z lower-cased, the rest of ASCII but letters and digits as spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Hashes(dict):
    """CRC-32 of words, computed once."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = zlib.crc32(word)
        return found


def buckets_of(text: bytes, hashes: Hashes, run: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature of a text."""
    words = text.translate(_LETTERS).split()
    level = list(map(hashes.__getitem__, words))
    out = level.copy()
    for n in range(1, run):  # a hash goes on where that of the shorter run ended
        level = list(map(zlib.crc32, words[n:], map(zlib.crc32, repeat(b" "), level)))
        out += level
    return len(words), np.array(out, dtype=np.int64) % buckets


def _counts(batches: Iterator[pa.RecordBatch], run: int, buckets: int) -> Iterator[pa.RecordBatch]:
    hashes, total = Hashes(), np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        if len(hashes) > REMEMBERED:
            hashes.clear()
        for text in batch.column(0):
            total += np.bincount(buckets_of(text.as_py() or b"", hashes, run, buckets)[1], minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])


def _weights(batches: Iterator[pa.RecordBatch], gains: np.ndarray, run: int) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        if len(hashes) > REMEMBERED:
            hashes.clear()
        words, features, weights = [], [], []
        for text in batch.column("_text"):
            n, found = buckets_of(text.as_py() or b"", hashes, run, len(gains))
            words.append(n)
            features.append(len(found))
            weights.append(int(gains[found].sum()) // len(found) if len(found) else 0)
        kept = [k for k, name in enumerate(batch.schema.names) if name != "_text"]
        columns = [batch.column(k) for k in kept] + [pa.array(x, pa.int64()) for x in (words, features, weights)]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[k] for k in kept] + ["n_words", "n_features", "weight"])


def bucket_counts(texts: DataFrame, *, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a collection fall into each bucket."""
    column = only(texts, _text=text_col).select(F.col("_text").cast("binary"))
    counted = column.mapInArrow(partial(_counts, run=run, buckets=buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, one more counted in each."""
    s, t = (bucket_counts(x, text_col=c, run=run, buckets=buckets) for x, c in ((docs, text_col), (target, target_col)))
    up, down = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * up) / (float(a + 1) * down))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def _scored(rows: DataFrame, found: np.ndarray, run: int, seed: int) -> DataFrame:
    """`rows` (with doc_id and a binary _text) with n_words, n_features, weight and score."""
    kind = StructType([f for f in rows.schema.fields if f.name != "_text"] + [StructField(c, LongType()) for c in ("n_words", "n_features", "weight")])
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.mapInArrow(partial(_weights, gains=found, run=run), kind).withColumn("score", F.col("weight") + noise)


def resampled(
    docs: DataFrame, target: DataFrame, *, share: int = SHARE, least: int = LEAST, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and, if it is drawn, rank: `share` percent
    of the documents with at least `least` words are."""
    found = gains(docs, target, text_col=text_col, target_col=target_col, run=run, buckets=buckets)
    rows = only(docs, doc_id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("binary"))
    scored = stored(_scored(rows, found, run, seed))
    enough = F.col("n_words") >= least
    order = ranked(scored.filter(enough), [("score", True), ("doc_id", False), ("n_features", False), ("weight", False)])
    drawn = scored.filter(enough).count() * share // 100
    return order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, *, share: int = SHARE, least: int = LEAST, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The drawn rows of `docs`, with exactly their columns. Only the place of the last drawn one is looked
    up; rows are scored again and kept where they are, so texts cross no shuffle. Rows equal in all but the
    text at that place are drawn together."""
    found = gains(docs, target, text_col=text_col, target_col=target_col, run=run, buckets=buckets)
    ranks = resampled(docs, target, share=share, least=least, run=run, buckets=buckets, seed=seed, id_col=id_col, text_col=text_col, target_col=target_col)
    last = ranks.filter("rank IS NOT NULL").orderBy(F.desc("rank")).first()
    if last is None:
        return docs.limit(0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    id_last = F.lit(last["doc_id"])
    before = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.col("doc_id") < id_last
    same = F.col("doc_id").eqNullSafe(id_last)
    rest = F.struct("n_features", "weight") <= F.struct(F.lit(last["n_features"]).cast("long"), F.lit(last["weight"]).cast("long"))
    kept = (F.col("n_words") >= least) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (F.coalesce(before, F.lit(False)) | (same & rest))))
    return _scored(rows, found, run, seed).filter(kept).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
