"""Vector joins: exact and approximate k nearest neighbours, neighbour counts, best reference.

A gallery whose size is checked to be below `broadcast_bytes` is broadcast, and the probes are scanned
without a shuffle. Beyond that all of them share one plan. Gallery rows go to the cell of their nearest pivot; probes go to every
cell that can still hold a match (exact) or to the `nprobe` nearest cells (approximate). On unit
vectors the squared euclidean distance is twice the cosine distance, so the triangle inequality on
pivots rules cells out without losing a pair. Rows whose vector is missing, or of another length than
the gallery's, are left out on both sides (`sources.tables.split_valid` lists them). The cells of a part are
cut into strips, and so are its probes, which bounds every task whatever the key distribution; a probe is sent
once to each strip that it visits, and each pair of strips is worked on in numpy products of bounded size that
return only the reduced rows, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.operators.common import spread, top_per_group
from vidspark.session import cut_lineage

MIN_BLOCK, MAX_BLOCK = 1024, 8192
MAX_CELLS = 1024
BROADCAST_BYTES = 64 << 20
SMALL = 1_000_000
#: Rows and bytes of vectors of a strip that a task holds, into how many strips a part and its probes are cut below
#: that, and the distances held at once.
STRIP, STRIP_BYTES, GALLERY_STRIPS, PROBE_STRIPS, SLAB = 32_768, 64 << 20, 4, 16, 2 << 20
_DIGITS = 12
_SLACK = 1e-9


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


Kernel = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame]


def choose_pivots(gallery: DataFrame, *, id: str, n: int) -> np.ndarray:
    """`n` gallery vectors in hash order: a bounded, repeatable choice that only steers routing, never
    the result."""
    n = _bounded(n)
    if n == 1:
        return np.zeros((0, 0))
    rows = gallery.orderBy(F.xxhash64(id), id).limit(n).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    return _units(pd.Series([r[0] for r in rows]))


def kmeans_centroids(gallery: DataFrame, *, k: int, seed: int = 7, max_iter: int = 10) -> np.ndarray:
    """Coarse quantiser for the approximate join, fitted distributed over the whole gallery. One cell
    needs no fit: it is the whole part."""
    if _bounded(k) < 2:
        return np.zeros((0, 0))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = gallery.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(feats)
    return _units(pd.Series(model.clusterCenters()))


def _bounded(cells: int) -> int:
    """Cells are held by every task; more than MAX_CELLS is refused rather than cut."""
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} cells; at most {MAX_CELLS} are supported")
    return max(1, cells)


def default_cells(n: int, block_rows: int) -> int:
    """About sqrt(n) cells, bounded; a single cell while everything fits in a few blocks."""
    return 1 if n <= 4 * block_rows else int(min(MAX_CELLS, round(n**0.5)))


def _to_pivots(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    u = _units(vectors)
    sq = (u**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * u @ pivots.T
    return np.sqrt(np.maximum(sq, 0.0, out=sq))


def _pivot_distances(pivots: np.ndarray) -> Callable[[Column], Column]:
    @F.pandas_udf("array<double>")
    def distances(v: pd.Series) -> pd.Series:
        return pd.Series(list(_to_pivots(v, pivots)))

    return distances


def _nearest_pivot(pivots: np.ndarray) -> Callable[[Column], Column]:
    """Nearest pivot and its distance; -1 and infinity where there is no vector."""

    @F.pandas_udf("cell int, radius double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.full(len(v), -1, dtype=np.int32), "radius": np.full(len(v), np.inf)})
        here = np.flatnonzero(v.notna())
        for low in range(0, len(here), 1024):
            at = here[low : low + 1024]
            d = _to_pivots(v.iloc[at], pivots)
            out.iloc[at, 0], out.iloc[at, 1] = d.argmin(1).astype(np.int32), d.min(1)
        return out

    return nearest


def _assign(gallery: DataFrame, pivots: np.ndarray, parts: Sequence[str], block_rows: int, whole_small: bool) -> DataFrame:
    """Add _cell and _radius. With `whole_small` (exact search, where it changes no result), parts that fit
    in one block are not cut (cell -1, radius unbounded)."""
    if len(pivots) < 2:
        return gallery.withColumn("_cell", F.lit(-1)).withColumn("_radius", F.lit(float("inf")))
    sizes = gallery.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    cut = (F.col("_n") > block_rows) | F.lit(not whole_small)
    near = gallery.join(sizes, list(parts)).withColumn("_near", _nearest_pivot(pivots)(F.when(cut, F.col("embedding"))))
    return near.withColumn("_cell", F.col("_near.cell")).withColumn("_radius", F.col("_near.radius")).drop("_near", "_n")


def _layout(cells: DataFrame, probes: DataFrame, parts: Sequence[str], *, n_rows: int, block_rows: int, most: int) -> DataFrame:
    """`cells` (parts, _cell, _g rows) with their place: the cells of a part stand behind each other and are cut into
    strips of `_strip` rows, of which a cell takes those from `_first` to `_last`. A strip has `block_rows` rows, or
    more where a part would have over GALLERY_STRIPS of them, up to the `most` that a task holds: so a probe is sent
    to a few strips, not to as many as there are blocks. Probes are cut likewise, into `_ps` strips. Parts of one
    block share a `_unit`, so that millions of little groups do not mean millions of little Python calls."""
    parts = list(parts)
    packs = max(1, -(-4 * n_rows // max(block_rows, MIN_BLOCK)))

    def strip(n: str, strips: int) -> Column:
        return F.least(F.lit(most), F.greatest(F.lit(block_rows), F.ceil(F.col(n) / F.lit(strips)))).cast("long")

    whole = cells.groupBy(*parts).agg(F.sum("_g").alias("_n")).join(probes.groupBy(*parts).agg(F.count(F.lit(1)).alias("_p")), parts)
    key = F.xxhash64(*parts)
    whole = whole.withColumn("_strip", strip("_n", GALLERY_STRIPS)).withColumn("_unit", F.when(F.col("_n") <= block_rows, F.pmod(key, F.lit(packs))).otherwise(key))
    asked = whole.groupBy("_unit").agg(F.sum("_p").alias("_up")).withColumn("_ps", F.ceil(F.col("_up") / strip("_up", PROBE_STRIPS)).cast("int"))
    before = F.coalesce(F.sum("_g").over(W.partitionBy(*parts).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = lambda n: F.floor(n / F.col("_strip")).cast("int")
    return (
        cells.withColumn("_before", before).join(whole.join(asked, "_unit").select(*parts, "_unit", "_strip", "_ps"), parts)
        .withColumn("_first", place(F.col("_before"))).withColumn("_last", place(F.col("_before") + F.col("_g") - 1))
    )


def _route(probes: DataFrame, cells: DataFrame, pivots: np.ndarray, parts: Sequence[str], *, reach: float | None, nprobe: int | None) -> DataFrame:
    """One row per (probe, strip to visit, `_gb`) with `_cells`, the cells to search there; null: see `_compared`.
    `cells` holds at most MAX_CELLS entries per part; without a layout each is a strip of its own."""
    parts, carried = list(parts), [c for c in ("_unit", "_ps") if c in cells.columns]
    if "_first" not in cells.columns:
        cells = cells.withColumn("_first", F.col("_cell")).withColumn("_last", F.col("_cell"))
    if len(pivots) < 2 or (nprobe is not None and nprobe >= len(pivots)):
        listed = cells.groupBy(*parts).agg(F.max("_last").alias("_end"), *[F.first(c).alias(c) for c in carried])
        return probes.join(listed, parts).withColumn("_gb", F.explode(F.sequence(F.lit(0), F.col("_end")))).withColumn("_cells", F.lit(None).cast("array<int>")).drop("_end")
    listed = cells.groupBy(*parts).agg(F.collect_list(F.struct("_cell", "_r", "_first", "_last")).alias("_listed"), *[F.first(c).alias(c) for c in carried])
    # the distances are used where they are made: they are many times as wide as a probe
    near = probes.join(listed, parts).withColumn("_pd", _pivot_distances(pivots)(F.col("embedding")))

    def seen(c: Column) -> Column:
        d = F.when(c["_cell"] >= 0, F.get(F.col("_pd"), c["_cell"])).otherwise(F.lit(0.0))
        return F.struct(d.alias("d"), c["_r"].alias("r"), c["_cell"].alias("cell"), c["_first"].alias("first"), c["_last"].alias("last"))

    dist = F.transform("_listed", seen)
    if nprobe is not None:
        visit = F.slice(F.array_sort(dist), 1, nprobe)
    else:
        visit = F.filter(dist, lambda c: c["d"] <= c["r"] + F.lit(reach + 1e-9))
    strips = F.array_distinct(F.flatten(F.transform("_visit", lambda c: F.sequence(c["first"], c["last"]))))
    chosen = F.transform(F.filter("_visit", lambda c: F.col("_gb").between(c["first"], c["last"])), lambda c: c["cell"])
    routed = near.withColumn("_visit", visit).drop("_pd", "_listed").withColumn("_gb", F.explode(strips))
    return routed.withColumn("_cells", F.lit(None).cast("array<int>") if nprobe is None else chosen).drop("_visit")


def _dimension(gallery: DataFrame, dim: int | None) -> tuple[int, int]:
    """(length of the vectors, rows that have it): the given one, else the most frequent. One pass over
    the gallery's vector sizes."""
    sizes = {r["d"]: r["n"] for r in gallery.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if dim is None:
        dim = max(sizes, key=lambda d: (sizes[d], d), default=0)
    return dim, sizes.get(dim, 0)


def _vector_join(
    probes: DataFrame, gallery: DataFrame, *, parts: Sequence[str], probe_id: str, gallery_id: str, method: str, threshold: float | None,
    nprobe: int, cells: int | None, pivots: np.ndarray | None, block_rows: int | None, broadcast_bytes: int, kernel: Kernel, schema: str, dim: int | None = None,
) -> DataFrame:
    """Apply `kernel` to probes and the gallery rows of their part, whole or in blocks."""
    dim, n_rows = _dimension(gallery, dim)
    # tied to a data column, so that a constant part is not folded out of the join keys
    probes, gallery = (
        x.filter(F.size("embedding") == dim).select(*[F.when(F.size("embedding") > 0, F.col(c)).alias(c) if c in parts else F.col(c) for c in x.columns])
        for x in (probes, gallery)
    )
    if method == "exact" and pivots is None and cells is None and n_rows <= SMALL and n_rows * dim * 8 <= broadcast_bytes:
        return _broadcast_join(probes, gallery, parts=parts, gallery_id=gallery_id, kernel=kernel, schema=schema)
    rows = block_rows or max(MIN_BLOCK, min(MAX_BLOCK, -(-n_rows // probes.sparkSession.sparkContext.defaultParallelism)))
    if pivots is None:
        # the exact search cuts every large part by the same pivots; parts of a few blocks need none
        largest = n_rows if cells or method == "ivf" else gallery.groupBy(*parts).count().agg(F.max("count")).first()[0] or 0
        n_cells = cells or default_cells(largest, rows)
        pivots = kmeans_centroids(gallery, k=n_cells) if method == "ivf" else choose_pivots(gallery, id=gallery_id, n=n_cells if threshold is not None else 1)
    reach = None if threshold is None else float(np.sqrt(2.0 * max(threshold, 0.0)))
    return _block_join(
        probes, gallery, parts=parts, probe_id=probe_id, gallery_id=gallery_id, pivots=pivots, n_rows=n_rows, dim=dim, reach=reach,
        nprobe=nprobe if method == "ivf" else None, block_rows=rows, kernel=kernel, schema=schema,
    )


def _broadcast_join(probes: DataFrame, gallery: DataFrame, *, parts: Sequence[str], gallery_id: str, kernel: Kernel, schema: str) -> DataFrame:
    """Probes scanned in place against a broadcast gallery of checked size."""
    parts = list(parts)
    held = gallery.toArrow().to_pandas().sort_values(gallery_id, kind="stable")
    by_part = {k: (g.drop(columns="embedding").reset_index(drop=True), _units(g["embedding"])) for k, g in held.groupby(parts, sort=False)}
    shared = probes.sparkSession.sparkContext.broadcast(by_part)
    empty = next(iter(by_part.values()), None)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        galleries = shared.value
        for b in batches:
            for key, rows in b.groupby(parts, sort=False):
                if key in galleries:
                    yield kernel(rows, *galleries[key])

    if empty is None:
        return probes.sparkSession.createDataFrame([], schema)
    # few probes sit in few files: spread the arithmetic; many are scanned where they are
    return (spread(probes) if probes.count() <= SMALL else probes).mapInPandas(scan, schema)


def _block_join(
    probes: DataFrame, gallery: DataFrame, *, parts: Sequence[str], probe_id: str, gallery_id: str, pivots: np.ndarray, n_rows: int, dim: int,
    reach: float | None, nprobe: int | None, block_rows: int, kernel: Kernel, schema: str,
) -> DataFrame:
    """Strips of both sides, co-grouped."""
    # fresh column identities, so that a table can be joined with itself
    gallery = gallery.select(*[F.col(c).alias(c) for c in gallery.columns])
    placed = _assign(gallery, pivots, parts, block_rows, nprobe is None)
    if len(pivots) > 1:
        placed = cut_lineage(placed)  # read twice below: place every vector once
    cells = placed.groupBy(*parts, "_cell").agg(F.max("_radius").alias("_r"), F.count(F.lit(1)).alias("_g"))
    return _blocks(placed, probes, cells, pivots=pivots, reach=reach, nprobe=nprobe, n_rows=n_rows, dim=dim, parts=parts, probe_id=probe_id, gallery_id=gallery_id, block_rows=block_rows, kernel=kernel, schema=schema)


def _compared(rows: pd.DataFrame, held: pd.DataFrame, pivots: np.ndarray, reach: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of probes and gallery rows of one part and strip that are to be compared: of every cell the probes that
    name it in `_cells`; where none is named, all cells that can hold a match within `reach`, or all."""
    names, of = np.unique(held["_cell"].to_numpy(), return_inverse=True)
    listed = rows["_cells"].notna().to_numpy()
    ask = np.ones((len(rows), len(names)), dtype=bool)
    for i in np.flatnonzero(listed):
        ask[i] = np.isin(names, rows["_cells"].iat[i])
    if reach is not None and len(pivots) > 1 and names[-1] >= 0:
        cut = names >= 0
        radius = np.zeros(len(names))
        np.maximum.at(radius, of, held["_radius"].to_numpy())
        for low in range(0, len(rows), 1024):
            ask[low : low + 1024, cut] &= _to_pivots(rows["embedding"].iloc[low : low + 1024], pivots[names[cut]]) <= radius[cut] + reach + 1e-9
    if ask.all():
        yield np.arange(len(rows)), np.arange(len(held))
        return
    for k in np.flatnonzero(ask.any(0)):
        yield np.flatnonzero(ask[:, k]), np.flatnonzero(of == k)


def _blocks(
    placed: DataFrame, probes: DataFrame, cells: DataFrame, *, parts: Sequence[str], probe_id: str, gallery_id: str, block_rows: int, n_rows: int, dim: int, kernel: Kernel, schema: str,
    pivots: np.ndarray, reach: float | None = None, nprobe: int | None = None, route: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Gallery rows (with _cell) and probes cut into strips, and every pair of strips that a probe visits given to the
    kernel, one part at a time. `cells` counts the gallery rows of each as `_g`; `route` (default: by the pivots)
    gives the strips that each probe visits."""
    parts = list(parts)
    most = max(MIN_BLOCK, min(STRIP, STRIP_BYTES // (8 * max(1, dim))))
    laid = _layout(cells, probes, parts, n_rows=n_rows, block_rows=block_rows, most=most)
    route = route or (lambda p, c: _route(p, c, pivots, parts, reach=reach, nprobe=nprobe))
    # a hash of the vector too: ids may repeat or be missing
    at = F.col("_before") + F.pmod(F.xxhash64(gallery_id, "embedding"), F.col("_g"))
    g = placed.join(laid.select(*parts, "_cell", "_g", "_before", "_strip", "_unit", "_ps"), [*parts, "_cell"])
    g = g.withColumn("_gb", F.floor(at / F.col("_strip")).cast("int")).withColumn("_pb", F.explode(F.sequence(F.lit(0), F.col("_ps") - 1)))
    p = route(probes, laid).withColumn("_pb", F.pmod(F.xxhash64(probe_id, "embedding"), "_ps").cast("int"))
    block = ["_unit", "_gb", "_pb"]
    p, g = (spread(x.select(*[F.col(c).alias(c) for c in x.columns if c not in ("_g", "_before", "_strip", "_ps")]), *block) for x in (p, g))

    def per_part(pb: pd.DataFrame, gb: pd.DataFrame) -> pd.DataFrame:
        galleries, out = dict(list(gb.sort_values(gallery_id, kind="stable").groupby(parts, sort=False))), []
        for key, rows in pb.groupby(parts, sort=False):
            if key in galleries:
                held = galleries[key]
                units = _units(held["embedding"])
                held = held.drop(columns="embedding")
                for asking, there in _compared(rows, held, pivots, reach):
                    out.append(kernel(rows.iloc[asking], held.iloc[there].reset_index(drop=True), units[there] if len(there) < len(units) else units))
        return pd.concat(out) if out else kernel(pb.iloc[:0], gb.iloc[:0], np.zeros((0, 1)))

    return p.groupBy(*block).cogroup(g.groupBy(*block)).applyInPandas(per_part, schema)


def _chunks(p: pd.DataFrame, units: np.ndarray):
    """Distance slabs of probes against gallery units, at most SLAB distances at a time, however long the gallery."""
    rows = max(1, min(512, SLAB // max(1, len(units))))
    for lo in range(0, len(p), rows):
        part = p.iloc[lo : lo + rows]
        d = _units(part["embedding"]) @ units.T
        yield part, np.subtract(1.0, d, out=d)


def _field(df: DataFrame, name: str, as_name: str | None = None) -> str:
    return f"`{as_name or name}` {df.schema[name].dataType.simpleString()}"


def _nearest(*, k: int, threshold: float, strict: bool, kept: Sequence[str], probe_id: str) -> Kernel:
    """The k nearest of a block's gallery rows for each of its probes."""
    kept = list(kept)

    def nearest(pb: pd.DataFrame, gb: pd.DataFrame, units: np.ndarray) -> pd.DataFrame:
        out = []
        if len(pb) and len(gb):
            kk = min(k, len(gb))
            width = max(1, min(64, len(gb) // (2 * kk)))
            for part_rows, d in _chunks(pb, units):
                # the k-th lowest of the minima of `width` columns each is no closer than the k-th nearest
                lows = d[:, : d.shape[1] // width * width].reshape(len(d), -1, width).min(2)
                keep = d <= np.minimum(np.partition(lows, kk - 1, axis=1)[:, kk - 1 : kk], threshold) + _SLACK
                r, c = np.nonzero(keep)
                v = np.round(d[r, c], _DIGITS)
                near = v < threshold if strict else v <= threshold
                r, c, v = r[near], c[near], v[near]
                order = np.lexsort((c, v, r))
                r, c, v = r[order], c[order], v[order]
                first = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
                r, c, v = r[first], c[first], v[first]
                hit = gb.loc[c, kept].reset_index(drop=True)
                hit.insert(0, probe_id, part_rows[probe_id].to_numpy()[r])
                hit["distance"] = v
                out.append(hit)
        return pd.concat(out) if out else pd.DataFrame(columns=[probe_id, *kept, "distance"])

    return nearest


def knn_join(
    probes: DataFrame, gallery: DataFrame, *, k: int, threshold: float = 0.40, part: str | Sequence[str] = "domain",
    cut: str = "before", method: str = "exact", nprobe: int = 16, cells: int | None = None,
    probe_id: str = "probe_id", gallery_id: str = "vec_id", carry: Sequence[str] = ("person_id",),
    pivots: np.ndarray | None = None, block_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, dim: int | None = None,
) -> DataFrame:
    """k nearest gallery rows per probe inside `part`, closer than `threshold`.

    `cut="before"` keeps distance < threshold, `cut="after"` keeps distance <= threshold (a cutoff
    applied to the ranked list selects the same rows). A threshold of 0 means the default 0.40.
    `method="exact"` visits every cell that can hold a match, `"ivf"` only the `nprobe` nearest of its part,
    whatever the part's size. `dim`: the vectors' length; by default the most frequent in the gallery.
    """
    threshold = threshold or 0.40
    parts = [part] if isinstance(part, str) else list(part)
    p = probes.select(probe_id, *parts, "embedding")
    g = gallery.select(gallery_id, *parts, *[c for c in carry if c not in parts], "embedding")
    kept = [gallery_id, *[c for c in carry if c not in parts]]
    schema = ", ".join([_field(p, probe_id), *[_field(g, c) for c in kept], "distance double"])
    local = _vector_join(
        p, g, parts=parts, probe_id=probe_id, gallery_id=gallery_id, method=method, threshold=threshold, nprobe=nprobe, cells=cells, pivots=pivots,
        block_rows=block_rows, broadcast_bytes=broadcast_bytes, schema=schema, dim=dim,
        kernel=_nearest(k=k, threshold=threshold, strict=cut == "before", kept=kept, probe_id=probe_id),
    )
    return top_per_group(local, [probe_id], [F.col("distance"), F.col(gallery_id)], k)


def _pieces(starts: np.ndarray, n: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of at most `width` columns inside the runs that begin at `starts`."""
    ends = np.r_[starts[1:], n]
    each = -(-(ends - starts) // width)
    low = np.repeat(starts, each) + width * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
    return low, np.minimum(low + width, np.repeat(ends, each))


def _first_per_key(key: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places of the k lowest values of every key, by key and value."""
    order = np.lexsort((v, key))
    sorted_key = key[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_key, sorted_key, side="left") < k]


def _lowest(
    d: np.ndarray, lows: np.ndarray, tile: np.ndarray, piece: np.ndarray, ends: np.ndarray, owner: np.ndarray, threshold: float, k: int, g: np.ndarray, who: np.ndarray,
) -> list[list[float]]:
    """The k lowest distances below `threshold` of each (tile of rows `g`, person `who`). They lie in the k pieces of
    columns whose minima (`lows`) are lowest, so only these are looked at."""
    size = int(owner.max()) + 1
    r, c = np.nonzero(lows < threshold)
    key = tile[r].astype(np.int64) * size + owner[c]
    best = _first_per_key(key, lows[r, c], k)
    r, c, key = r[best], c[best], key[best]
    at = piece[c][:, None] + np.arange((ends - piece).max())
    inside = at < ends[c][:, None]
    v = np.where(inside, d[r[:, None], np.where(inside, at, 0)], np.inf)
    near = v < threshold
    key, v = np.broadcast_to(key[:, None], v.shape)[near], v[near]
    best = _first_per_key(key, v, k)
    key, v = key[best], v[best]
    wanted = g.astype(np.int64) * size + who
    return [v[x:y].tolist() for x, y in zip(np.searchsorted(key, wanted, side="left"), np.searchsorted(key, wanted, side="right"))]


def match_folds(
    probes: DataFrame, gallery: DataFrame, *, group: str = "image_id", person: str = "person_id", threshold: float, thresholds: Sequence[float] = (),
    part: str | Sequence[str] = "domain", probe_id: str = "probe_id", gallery_id: str = "vec_id", lowest: int = 3, first: Sequence[str] = (), within: float | None = None, **blocks,
) -> DataFrame:
    """All matches below `threshold`, folded per (`group`, `person`) inside the block kernel, so that no pair
    leaves it: n, sum, minimum, maximum, the `lowest` smallest distances, and n_0, n_1, ... below each of
    `thresholds`. Unlike a join cut at k, counts and means are those of every match. `first`: columns of the
    probe with the lowest id among those that have a match closer than `within` (default: `threshold`)."""
    parts = [part] if isinstance(part, str) else list(part)
    first, limit = list(first), max(threshold, within or 0.0)
    p = probes.select(probe_id, group, *parts, *first, "embedding")
    g = gallery.select(gallery_id, person, *parts, "embedding")
    counts = [f"n_{i}" for i in range(len(thresholds))]
    columns = [group, person, "n", "s", "hi", "lows", *counts, "_first", *first]

    def fold(pb: pd.DataFrame, gb: pd.DataFrame, units: np.ndarray) -> pd.DataFrame:
        out = []
        if len(pb) and len(gb):
            # by image and by person, so that all pairs of both are a tile of the slab
            people, person_names = pd.factorize(gb[person], use_na_sentinel=False)
            order = np.argsort(people, kind="stable")
            people, units = people[order], units[order]
            starts = np.flatnonzero(np.r_[True, people[1:] != people[:-1]])
            piece, ends = _pieces(starts, len(people))
            owner = people[piece]
            in_piece = np.searchsorted(piece, starts)
            pb = pb.assign(_g=pd.factorize(pb[group], use_na_sentinel=False)[0]).sort_values(["_g", probe_id], kind="stable")
            for part_rows, d in _chunks(pb, units):
                d = np.round(d, _DIGITS, out=d)
                lows = np.minimum.reduceat(d, piece, axis=1)
                some = np.minimum.reduceat(lows, in_piece, axis=1) < limit
                if not some.any():
                    continue
                of = part_rows["_g"].to_numpy()
                tops = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                tile = np.repeat(np.arange(len(tops)), np.diff(np.r_[tops, len(of)]))
                lead = np.minimum.reduceat(np.where(some, np.arange(len(of))[:, None], len(of)), tops, axis=0)
                g, who = np.nonzero(lead < len(of))
                lead = lead[g, who]

                def folded(values: np.ndarray, op: np.ufunc, g=g, who=who, tops=tops, **kind) -> np.ndarray:
                    return op.reduceat(op.reduceat(values, starts, axis=1, **kind), tops, axis=0)[g, who]

                close = d < threshold
                n = folded(close, np.add, dtype=np.int64)
                rows = {
                    group: part_rows[group].to_numpy()[lead], person: person_names.take(people[starts[who]]), "n": n, "s": folded(np.where(close, d, 0.0), np.add),
                    "hi": folded(np.where(close, d, -np.inf), np.maximum), "lows": _lowest(d, lows, tile, piece, ends, owner, threshold, lowest, g, people[starts[who]]),
                    **{name: folded(d < min(t, threshold), np.add, dtype=np.int64) for name, t in zip(counts, thresholds)},
                    "_first": part_rows[probe_id].to_numpy()[lead], **{f: part_rows[f].to_numpy()[lead] for f in first},
                }
                out.append(pd.DataFrame(rows))
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    carried = [_field(p, probe_id, "_first"), *[_field(p, f) for f in first]]
    schema = ", ".join([_field(p, group), _field(g, person), "n long", "s double", "hi double", "lows array<double>", *[f"{c} long" for c in counts], *carried])
    options = {"cells": None, "pivots": None, "block_rows": None, "broadcast_bytes": BROADCAST_BYTES, **blocks}
    local = _vector_join(p, g, parts=parts, probe_id=probe_id, gallery_id=gallery_id, method="exact", threshold=limit, nprobe=0, kernel=fold, schema=schema, **options)
    return local.groupBy(group, person).agg(
        F.sum("n").alias("n"), F.sum("s").alias("sum_distance"), F.max("hi").alias("max_distance"),
        F.slice(F.sort_array(F.flatten(F.collect_list("lows"))), 1, lowest).alias("lowest"), *[F.sum(c).alias(c) for c in counts],
        *[F.min_by(f, "_first").alias(f) for f in first],
    ).filter("n > 0").withColumn("min_distance", F.get("lowest", F.lit(0)))


def neighbour_stats(
    vectors: DataFrame, *, group: str, threshold: float, id: str = "vec_id", cells: int | None = None,
    pivots: np.ndarray | None = None, block_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Pairwise distances inside a group, reduced per row: how many rows (itself included) are closer
    than `threshold`, and the smallest and mean distance of those other rows. Pairs are never emitted."""
    v = vectors.select(id, group, "embedding")

    def reduce(pb: pd.DataFrame, gb: pd.DataFrame, units: np.ndarray) -> pd.DataFrame:
        out = []
        if len(pb) and len(gb):
            gid = gb[id].to_numpy()
            for part_rows, d in _chunks(pb, units):
                d = np.round(d, _DIGITS, out=d)
                near = d < threshold
                other = near & (part_rows[id].to_numpy()[:, None] != gid[None, :])
                out.append(pd.DataFrame({
                    group: part_rows[group].to_numpy(), id: part_rows[id].to_numpy(),
                    "n": near.sum(1), "m": other.sum(1), "s": np.where(other, d, 0.0).sum(1),
                    "lo": np.where(other, d, np.inf).min(1),
                }))
        return pd.concat(out) if out else pd.DataFrame(columns=[group, id, "n", "m", "s", "lo"])

    schema = f"{_field(v, group)}, {_field(v, id)}, n long, m long, s double, lo double"
    partial = _vector_join(
        v, v, parts=[group], probe_id=id, gallery_id=id, method="exact", threshold=threshold, nprobe=0, cells=cells, pivots=pivots,
        block_rows=block_rows, broadcast_bytes=broadcast_bytes, kernel=reduce, schema=schema,
    )
    return partial.groupBy(group, id).agg(
        F.sum("n").alias("neighbours"),
        F.when(F.sum("m") > 0, F.min("lo")).alias("min_distance"),
        F.when(F.sum("m") > 0, F.sum("s") / F.sum("m")).alias("mean_distance"),
    )


def consensus(
    vectors: DataFrame, *, group: str, threshold: float = 0.50, min_size: int = 4, id: str = "vec_id", **blocks,
) -> DataFrame:
    """Largest neighbourhood of each group: the row with most neighbours (ties: lowest id) and every
    row closer than `threshold` to it, where that makes at least `min_size` rows."""
    from vidspark.functions.vectors import cosine_distance

    counts = neighbour_stats(vectors, group=group, threshold=threshold, id=id, **blocks)
    centre = counts.groupBy(group).agg(
        F.max_by(id, F.struct("neighbours", (-F.col(id)).alias("low"))).alias("centre_id"),
        F.max("neighbours").alias("cluster_size"),
    ).filter(F.col("cluster_size") >= min_size)
    centre_vec = centre.join(
        vectors.select(group, F.col(id).alias("centre_id"), F.col("embedding").alias("_centre")), [group, "centre_id"]
    )
    d = F.round(cosine_distance(F.col("embedding"), F.col("_centre")), _DIGITS)
    return (
        vectors.join(centre_vec, group).withColumn("distance", d)
        .filter(F.col("distance") < threshold).drop("_centre")
    )


def validate_against(
    candidates: DataFrame, references: DataFrame, *, on: str, threshold: float = 0.50, id: str = "cand_id",
    ref_index: str = "ref_idx", block_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each candidate against all references of its group: the smallest distance and its reference,
    the first reference in index order that passes, accepted or not. Candidates whose group has no
    reference are kept and not accepted."""
    c = candidates.select(id, on, "embedding")
    r = references.select(ref_index, on, "embedding")
    def best(pb: pd.DataFrame, gb: pd.DataFrame, units: np.ndarray) -> pd.DataFrame:
        out = []
        if len(pb) and len(gb):
            idx = gb[ref_index].to_numpy()
            for part_rows, d in _chunks(pb, units):
                d = np.round(d, _DIGITS, out=d)
                low, ok = d.argmin(1), d < threshold
                first = np.where(ok.any(1), idx[ok.argmax(1)], -1)
                out.append(pd.DataFrame({
                    id: part_rows[id].to_numpy(), "d": d[np.arange(len(d)), low], "ref": idx[low],
                    "first": pd.array(np.where(ok.any(1), first, 0), dtype="Int64"), "hit": ok.any(1),
                }))
        return pd.concat(out) if out else pd.DataFrame(columns=[id, "d", "ref", "first", "hit"])

    schema = f"{_field(c, id)}, d double, ref long, first long, hit boolean"
    part = _vector_join(
        c, r, parts=[on], probe_id=id, gallery_id=ref_index, method="exact", threshold=None, nprobe=0, cells=None, pivots=None,
        block_rows=block_rows, broadcast_bytes=broadcast_bytes, kernel=best, schema=schema,
    )
    merged = part.groupBy(id).agg(
        F.min(F.struct("d", "ref")).alias("_m"), F.min(F.when(F.col("hit"), F.col("first"))).alias("first_passing_ref"),
    )
    return candidates.drop("embedding").join(merged, id, "left").select(
        *[x for x in candidates.columns if x != "embedding"],
        F.col("_m.d").alias("min_distance"), F.col("_m.ref").alias("best_ref"), "first_passing_ref",
        F.col("first_passing_ref").isNotNull().alias("accepted"),
    )


def verify_single(candidates: DataFrame, reference: DataFrame, *, on: str, threshold: float = 0.75) -> DataFrame:
    """One reference per group: distance to it and whether it is below the threshold."""
    from vidspark.functions.vectors import cosine_distance

    ref = reference.select(on, F.col("embedding").alias("_ref"))
    return (
        candidates.join(ref, on)
        .withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.col("_ref")), _DIGITS))
        .withColumn("verified", F.col("distance") <= threshold)
        .drop("_ref", "embedding")
    )
