"""A stored vector index: fitted once, kept as a table by cell, grown by inserts, searched many times.

Two levels of centroids. The coarse ones are fitted over a bounded sample, the fine ones of each coarse cell
over its share of it, each in one task; a row goes to the nearest fine cell of its nearest coarse one. The
sample only lays out cells: every row is stored, and with every cell visited the search is exact. The table
is partitioned by cell, so a search reads the files of the cells that its probes visit and no others.

Rows whose vector is missing or of another length than the index's are left out, as in `search`. Inserts are
appended under the stored centroids, the way a batch job appends; a repeated insert stores its rows twice, so
give each batch once. The centroids go to every task; more than QUANTISER_BYTES of them is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.operators.common import spread, top_per_group
from vidspark.operators.search import BROADCAST_BYTES, MAX_BLOCK, _blocks, _dimension, _field, _nearest, _units
from vidspark.session import cut_lineage

#: Rows of the sample per cell, and bytes of centroids that a task may hold.
SAMPLED, QUANTISER_BYTES = 64, 256 << 20


@dataclass(frozen=True)
class VectorIndex:
    """Where the rows are, their columns, and the centroids: coarse (k x dim) and fine (cell -> coarse cell)."""

    path: str
    parts: tuple[str, ...]
    id: str
    carry: tuple[str, ...]
    coarse: np.ndarray
    fine: np.ndarray
    owner: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.fine)

    @property
    def dim(self) -> int:
        return self.fine.shape[1]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def _distances(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    sq = (units**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2.0 * units @ centroids.T
    return np.maximum(sq, 0.0)


def _lloyd(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centroids of a bounded sample, from its first distinct points on."""
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        near = _distances(points, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _assigned(rows: DataFrame, coarse: np.ndarray, fine: np.ndarray, owner: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        u = _units(v)
        top, out = _distances(u, coarse).argmin(1), np.empty(len(u), dtype=np.int32)
        for c in np.unique(top):
            here, inside = np.flatnonzero(top == c), np.flatnonzero(owner == c)
            out[here] = inside[_distances(u[here], fine[inside]).argmin(1)]
        return pd.Series(out)

    return rows.withColumn("_cell", cell(F.col("embedding")))


def build_index(
    gallery: DataFrame, path: str, *, cells: int, part: str | Sequence[str] = "domain", id: str = "vec_id", carry: Sequence[str] = ("person_id",), dim: int | None = None,
) -> VectorIndex:
    """Fit the centroids, store them and every row of the gallery under `path`."""
    parts = [part] if isinstance(part, str) else list(part)
    dim, n = _dimension(gallery, dim)
    if cells * dim * 8 > QUANTISER_BYTES:
        raise ValueError(f"{cells} cells of {dim} numbers; centroids may take {QUANTISER_BYTES} bytes")
    wide = max(1, round(cells**0.5))
    vectors = gallery.filter(F.size("embedding") == dim).select(id, "embedding")
    sample = vectors if n <= SAMPLED * cells else vectors.filter(F.pmod(F.xxhash64(id, F.lit(7)), F.lit(-(-n // (SAMPLED * cells)))) == 0)
    drawn = cut_lineage(sample)  # about SAMPLED rows per cell, whatever the gallery
    head = drawn.orderBy(F.xxhash64(id), id).limit(SAMPLED * wide * 4).select("embedding").collect()
    coarse = _lloyd(_units(pd.Series([r[0] for r in head])), wide) if head else np.zeros((1, dim))
    each = -(-cells // len(coarse))

    @F.pandas_udf("int")
    def nearest_coarse(v: pd.Series) -> pd.Series:
        return pd.Series(_distances(_units(v), coarse).argmin(1).astype(np.int32))

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = _lloyd(_units(rows.sort_values(id, kind="stable")["embedding"]), each)
        return pd.DataFrame({"coarse": key[0], "centroid": list(found)})

    # at most SAMPLED x cells rows in all, so a group is bounded too
    groups = drawn.withColumn("coarse", nearest_coarse(F.col("embedding"))).groupBy("coarse").applyInPandas(fitted, "coarse int, centroid array<double>")
    found = sorted((r["coarse"], list(r["centroid"])) for r in groups.collect())  # as many rows as cells
    owner = np.array([c for c, _ in found], dtype=np.int32)
    fine = np.array([v for _, v in found], dtype=np.float64).reshape(len(found), dim)
    coarse = coarse[np.unique(owner)] if len(owner) else coarse
    owner = np.searchsorted(np.unique(owner), owner)
    table = [(int(o), coarse[o].tolist(), f.tolist()) for o, f in zip(owner, fine)]
    gallery.sparkSession.createDataFrame(table, "owner int, coarse array<double>, fine array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    index = VectorIndex(path, tuple(parts), id, tuple(c for c in carry if c not in parts), coarse, fine, owner)
    insert(index, gallery)
    return index


def open_index(spark: SparkSession, path: str, *, part: str | Sequence[str] = "domain", id: str = "vec_id", carry: Sequence[str] = ("person_id",)) -> VectorIndex:
    """The index stored under `path`; nothing is fitted."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("owner").collect()  # as many rows as cells
    parts = [part] if isinstance(part, str) else list(part)
    owner = np.array([r["owner"] for r in rows])
    coarse = np.array([rows[np.flatnonzero(owner == o)[0]]["coarse"] for o in np.unique(owner)])
    return VectorIndex(path, tuple(parts), id, tuple(c for c in carry if c not in parts), coarse, np.array([r["fine"] for r in rows]), owner)


def insert(index: VectorIndex, rows: DataFrame) -> None:
    """Append rows under the stored centroids."""
    kept = rows.filter(F.size("embedding") == index.dim).select(index.id, *index.parts, *index.carry, "embedding")
    # one writer per cell and salt: few files, and a cell with a third of the rows is written by several tasks
    laid = _assigned(kept, index.coarse, index.fine, index.owner).withColumn("_salt", F.pmod(F.xxhash64(index.id), F.lit(8)))
    spread(laid, "_cell", "_salt").drop("_salt").write.mode("append").partitionBy("_cell").parquet(f"{index.path}/rows")


def visited_cells(index: VectorIndex, probes: DataFrame, *, nprobe: int) -> DataFrame:
    """One row per probe and cell: the `nprobe` nearest cells, looked for in as many of the nearest coarse
    cells as hold twice that many."""
    coarse, fine, owner = index.coarse, index.fine, index.owner
    sizes = np.bincount(owner, minlength=len(coarse))
    wanted = min(nprobe, len(fine))

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        u = _units(v)
        order = np.argsort(_distances(u, coarse), axis=1, kind="stable")
        d = np.sqrt(_distances(u, fine))
        needed = (np.cumsum(sizes[order], axis=1) < 2 * wanted).sum(1) + 1
        for i, n in enumerate(needed):
            d[i, ~np.isin(owner, order[i, :n])] = np.inf
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :wanted].astype(np.int32)))

    return probes.withColumn("_cell", F.explode(near(F.col("embedding"))))


def _stored_strips(index: VectorIndex, laid: DataFrame, routed: DataFrame, probe_id: str) -> DataFrame:
    """One row per probe and strip of the layout, with the cells that the probe visits there."""
    parts = list(index.parts)
    where = laid.select(*parts, "_cell", "_unit", "_ps", F.explode(F.sequence("_first", "_last")).alias("_gb"))
    return routed.join(where, [*parts, "_cell"]).groupBy("_row", *parts, "_unit", "_ps", "_gb").agg(
        F.first(probe_id).alias(probe_id), F.first("embedding").alias("embedding"), F.collect_list("_cell").alias("_cells"))


def search_index(
    index: VectorIndex, probes: DataFrame, *, k: int, threshold: float = 0.40, nprobe: int = 16, cut: str = "before", probe_id: str = "probe_id",
    block_rows: int = MAX_BLOCK, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """k nearest stored rows per probe among the `nprobe` nearest cells, inside the index's parts. Probes
    checked to be few are sent to the stored rows, which stay where they are; others meet them in strips,
    where a probe is sent once to all the cells that it visits."""
    spark, parts, keys = probes.sparkSession, list(index.parts), [*index.parts, "_cell"]
    asked = probes.filter(F.size("embedding") == index.dim).select(probe_id, *parts, "embedding")
    every = nprobe >= index.cells
    asked = cut_lineage(asked if every else asked.withColumn("_row", F.monotonically_increasing_id()))
    n_asked = asked.count()
    routed = asked if every else cut_lineage(visited_cells(index, asked, nprobe=nprobe))
    stored = index.rows(spark)
    if not every:
        cells = [r[0] for r in routed.select("_cell").distinct().collect()]  # at most as many as there are
        if len(cells) < index.cells:
            stored = stored.filter(F.col("_cell").isin(cells))
    kept = [index.id, *index.carry]
    kernel = _nearest(k=k, threshold=threshold or 0.40, strict=cut == "before", kept=kept, probe_id=probe_id)
    schema = ", ".join([_field(asked, probe_id), *[_field(stored, c) for c in kept], "distance double"])
    by = parts if every else keys
    if n_asked * min(nprobe, index.cells) * index.dim * 8 <= broadcast_bytes:
        held = spark.sparkContext.broadcast({key: rows for key, rows in routed.toPandas().groupby(by, sort=False)})

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asking = held.value
            for b in batches:
                for key, rows in b.groupby(by, sort=False):
                    if key in asking:
                        rows = rows.sort_values(index.id, kind="stable").reset_index(drop=True)
                        yield kernel(asking[key], rows, _units(rows["embedding"]))

        local = stored.mapInPandas(scan, schema)
    else:
        counted = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g"))
        n_rows = counted.agg(F.sum("_g")).first()[0] or 0
        local = _blocks(
            stored, asked, counted, parts=parts, probe_id=probe_id, gallery_id=index.id, block_rows=block_rows, n_rows=n_rows, dim=index.dim, kernel=kernel, schema=schema,
            pivots=np.zeros((0, 0)), route=None if every else lambda _, laid: _stored_strips(index, laid, routed, probe_id),
        )
    return top_per_group(local, [probe_id], [F.col("distance"), F.col(index.id)], k)
