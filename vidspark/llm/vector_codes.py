"""Vectors compressed to codes: one codebook entry per part.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook.
Training works on distinct parts with their number of vectors: they are counted before they are shuffled,
laid out once in ranges of (position, part) and sorted, so that equal prefixes stand together, and stored.
A round walks the trie of the stored parts (`part_trie`) task by task and returns weighted sums per entry,
at most positions x entries rows a task; the codebooks (positions x entries x width numbers) are all that
the driver holds. At last every vector is coded where it is read, by the same trie over its batch.

Defined results: vectors that are null, hold null or non-finite components or are of another length than
that of the smallest vec_id left (a whole number of parts; of equal ids the smallest vector counts, null ids
last) are dropped; whole numbers are held within +-2^28, so that all sums of squares are exact; fewer vectors
than entries give fewer entries; an entry that no part is nearest to stays as it is; ties go to the lower
index; repeated rows are coded each, null ids stay null; labels are summed with nulls together; an empty
table gives an empty result; further columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.part_trie import nearest, nearest_of_any
from vidspark.llm.text import only
from vidspark.session import stored

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT = 16, 64, 2, 256, 1 << 28
#: A label with more than one of so many rows is looked up in a small table instead of being shuffled to one task.
HOT = 1000


def whole_numbers(vectors: DataFrame, *, parts: int = PARTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and the vector in whole numbers, of all rows that are kept."""
    rows = only(vectors, vec_id=id_col, label=label_col, _v=vector_col)
    kept = rows.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    kept = kept.filter(~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    held = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x.cast("double") * scale).cast("double"))).cast("int")
    return kept.select("vec_id", "label", F.transform("_v", held).alias("_whole"))


def _first_vectors(rows: DataFrame, entries: int) -> list[list[int]]:
    """Vectors of the `entries` smallest ids, all of the first one's length: at most so many rows at a time
    reach the driver; an id with many rows only costs another look."""
    found: dict = {}
    rest, width = rows, None
    while len(found) < entries:
        seen = rest.orderBy(F.col("vec_id").asc_nulls_last(), F.size("_whole"), "_whole").limit(entries).collect()
        if not seen:
            break
        for r in seen:
            width = width or len(r["_whole"])
            if len(r["_whole"]) == width and len(found) < entries:
                found.setdefault(r["vec_id"], r["_whole"])
        if seen[-1]["vec_id"] is None or len(seen) < entries:
            break
        rest = rows.filter((F.col("vec_id") > F.lit(seen[-1]["vec_id"])) | F.col("vec_id").isNull()).filter(F.size("_whole") == width)
    return list(found.values())


def _distinct(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """position, part and its number, in ranges and sorted."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("position"), F.slice("_whole", p * width + 1, width).alias("part")))
    counted = rows.select(F.explode(cut).alias("_p")).select("_p.*").groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    return counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part")


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per position and entry: number and componentwise sums of the parts nearest to it."""
    parts, entries, width = books.shape
    total, count = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
    for batch in batches:
        position, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("position", "n"))
        values = _flat(batch.column("part"), width)
        for p in np.unique(position):  # sorted, so each is one stretch of the batch
            here = slice(*np.searchsorted(position, [p, p + 1]))
            chosen, _ = nearest(values[here], books[p])
            np.add.at(total[p], chosen, values[here] * n[here, None])
            np.add.at(count[p], chosen, n[here])
    p, e = np.nonzero(count)
    columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "n", "sums"])


def trained(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (position, entry, component) of vectors in whole numbers; none of an empty table."""
    first = _first_vectors(rows, entries)
    if not first:
        return None
    width = len(first[0]) // parts
    books = np.array(first, dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if not rounds:
        return books
    laid = stored(_distinct(rows.filter(F.size("_whole") == parts * width), parts, width))
    added = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    for _ in range(rounds):
        sums = laid.sortWithinPartitions("position", "part").mapInArrow(partial(_sums, books=books), "position int, entry int, n long, sums array<long>")
        new = books.copy()
        for r in sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *added).collect():  # at most positions x entries rows
            new[r["position"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
        books = new
    return books


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        values = _flat(batch.column("_whole"), parts * width)
        code, error = np.empty((len(values), parts), dtype=np.int64), np.zeros(len(values), dtype=np.int64)
        for p in range(parts):
            code[:, p], far = nearest_of_any(values[:, p * width : (p + 1) * width], books[p])
            error += far
        columns = [batch.column("vec_id"), batch.column("label"), pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())), pa.array(error)]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "codes", "error"])


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (one index per part) and error of vectors in whole numbers."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fitting = rows.filter(F.size("_whole") == books.shape[0] * books.shape[2])
    return fitting.mapInArrow(partial(_codes, books=books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def with_label_error(codes: DataFrame) -> DataFrame:
    """`codes` (stored) with the sum of the errors of its label. Sums are made before the shuffle; labels
    that many rows have, at most HOT of them, are looked up without one."""
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot = (F.col("_n") * HOT > total) | F.col("label").isNull()
    often = sums.filter(hot).select(F.col("label").alias("_label"), "label_error")
    known = codes.join(F.broadcast(often.withColumn("_often", F.lit(True))), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    rest = known.filter("_often IS NULL").drop("label_error", "_often").join(sums.filter(~hot).drop("_n"), "label")
    return known.filter("_often").drop("_often").unionByName(rest)


def compressed(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, codes, error and label_error of every kept vector, and the codebooks."""
    rows = whole_numbers(vectors, parts=parts, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col)
    books = trained(rows, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        none = rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.limit(0), None
    return with_label_error(stored(coded(rows, books))), books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components in decimal by position, entry and component, joined by commas."""
    values = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()
