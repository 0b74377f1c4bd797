"""Ranks by a distributed radix sort from the lowest digit up.

The composite key, whole numbers from the most to the least significant, is taken apart into digits. Each
pass is one stable counting sort over all tasks: every partition counts its digits, prefix sums over digits
and, within a digit, partitions give the first destination of each (partition, digit), and the rows of a
partition, read in their present order, go to consecutive destinations, dealt to partitions of equal size.
Positions are dense after every pass, so no key, however common, makes a partition larger than another.

The counts that the driver sees are at most COUNTS numbers: the width of a digit follows from the number of
partitions. A partition holds about ROWS rows, which a task lays out in memory. Passes are cut by checkpoints.

Defined results: nulls of a key rank last in either direction; rows equal in all keys keep some order; equal
ranks do not occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.session import cut_lineage

ROWS, COUNTS, FEWEST = 500_000, 1 << 20, 10_000


@dataclass(frozen=True)
class Digit:
    """Some bits of one key, counted from its smallest (or, descending, largest) value; nulls behind all."""

    column: str
    origin: int
    descending: bool
    nulls: int
    shift: int
    width: int

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        values = batch.column(batch.schema.get_field_index(self.column))
        known = pc.fill_null(values, self.origin).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        origin = np.uint64(self.origin % (1 << 64))
        code = origin - known if self.descending else known - origin  # modulo 2^64, as both lie in one range
        if values.null_count:
            code = np.where(values.is_null().to_numpy(zero_copy_only=False), np.uint64(self.nulls), code)
        return ((code >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)).astype(np.uint16)


def _counts(batches: Iterator[pa.RecordBatch], digit: Digit) -> Iterator[pa.RecordBatch]:
    pid, total = None, np.zeros(1 << digit.width, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            pid = batch.column("_pid")[0].as_py()
            total += np.bincount(digit.of(batch), minlength=len(total))
    if pid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["pid", "counts"])


def _moved(batches: Iterator[pa.RecordBatch], digit: Digit, first: np.ndarray, chunk: int, in_order: bool) -> Iterator[pa.RecordBatch]:
    if not in_order:  # about `chunk` rows, laid out by their positions
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        order = np.empty(table.num_rows, dtype=np.int64)
        order[table.column("_in").to_numpy()] = np.arange(table.num_rows)
        batches = iter(table.take(pa.array(order)).combine_chunks().to_batches())
    following = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if following is None:
            following = first[batch.column("_pid")[0].as_py()].copy()
        digits = digit.of(batch)
        grouped = np.argsort(digits, kind="stable")
        n = np.bincount(digits, minlength=len(following))
        start = np.cumsum(n) - n
        place = np.empty(len(digits), dtype=np.int64)
        place[grouped] = np.arange(len(digits)) - start[digits[grouped]]
        place += following[digits]
        following += n
        columns = [batch.column(k) if f.name not in ("_pid", "_in") else pa.array(place // chunk, pa.int32()) if f.name == "_pid" else pa.array(place % chunk, pa.int64()) for k, f in enumerate(batch.schema)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _digits(rows: DataFrame, keys: Sequence[tuple[str, bool]], width: int) -> list[Digit]:
    """Digits of all keys, lowest first; a key with one value has none."""
    found = rows.agg(*[f(c).alias(f"{k}_{k2}") for k, (c, _) in enumerate(keys) for k2, f in enumerate((F.min, F.max, F.count))], F.count(F.lit(1)).alias("n")).first()
    out = []
    for k, (column, descending) in reversed(list(enumerate(keys))):
        low, high, known = (found[f"{k}_{j}"] for j in range(3))
        span = high - low if known else 0
        nulls = min(span + 1, (1 << 64) - 1)
        bits = (nulls if known < found["n"] and known else span).bit_length()
        parts = math.ceil(bits / width)
        each = math.ceil(bits / parts) if parts else 0
        out += [Digit(column, (high if descending else low) if known else 0, descending, nulls if known else 0, s, min(each, bits - s)) for s in range(0, bits, each or 1)]
    return out


def ranked(rows: DataFrame, keys: Sequence[tuple[str, bool]], *, rank_col: str = "rank", rows_each: int = ROWS, counts: int = COUNTS) -> DataFrame:
    """`rows` (narrow; integer key columns, all names plain) with their rank, 1 first. `keys`: (column,
    descending) from the most significant on."""
    columns = rows.columns
    laid = cut_lineage(rows.withColumn("_pid", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    total = laid.count()
    if total == 0:
        return rows.withColumn(rank_col, F.lit(None).cast("long"))
    given = laid.agg(F.max("_pid")).first()[0] + 1
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(math.ceil(total / rows_each), min(usual, math.ceil(total / FEWEST)))
    chunk = math.ceil(total / partitions)
    width = max(1, min(16, int(math.log2(max(2, counts / max(given, partitions))))))
    some = Digit(keys[-1][0], 0, False, 0, 0, 0)  # one value: the pass only numbers the rows
    for k, digit in enumerate(_digits(laid, keys, width) or [some]):
        seen = laid.mapInArrow(partial(_counts, digit=digit), "pid int, counts binary").collect()  # one row a partition, `counts` numbers in all
        table = np.zeros((max(given, partitions), 1 << digit.width), dtype=np.int64)
        for r in seen:
            table[r["pid"]] = np.frombuffer(r["counts"], dtype=np.int64)
        flat = table.T.ravel()
        first = (np.cumsum(flat) - flat).reshape(table.T.shape).T
        moved = laid.mapInArrow(partial(_moved, digit=digit, first=np.ascontiguousarray(first), chunk=chunk, in_order=k == 0), laid.schema)
        laid = cut_lineage(moved.repartitionById(partitions, F.col("_pid")))
    return laid.select(*columns, (F.col("_pid") * F.lit(chunk).cast("long") + F.col("_in") + 1).alias(rank_col))
