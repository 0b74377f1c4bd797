"""Vector joins against brute force, with every plan forced on small input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vidspark.operators import search

RNG = np.random.default_rng(3)


def table(spark, vecs, parts, id="vec_id"):
    rows = [(i, p, [float(x) for x in v]) for i, (v, p) in enumerate(zip(vecs, parts))]
    return spark.createDataFrame(rows, f"{id} long, domain string, embedding array<double>")


def distances(p, g):
    def units(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    return np.round(1 - units(p) @ units(g).T, 12)


def brute(p, pp, g, gp, k, t, strict=True):
    d, out = distances(p, g), set()
    for i in range(len(p)):
        ok = [j for j in range(len(g)) if gp[j] == pp[i] and (d[i, j] < t if strict else d[i, j] <= t)]
        out |= {(i, r + 1, j) for r, j in enumerate(sorted(ok, key=lambda j: (d[i, j], j))[:k])}
    return out


@pytest.fixture(scope="module")
def data():
    """Clusters, exact copies and zero vectors; one part holds most rows."""
    centres = RNG.normal(size=(6, 8))
    g = centres[RNG.integers(0, 6, 300)] + 0.3 * RNG.normal(size=(300, 8))
    g[50:120] = g[0]
    g[200:203] = 0
    p = centres[RNG.integers(0, 6, 120)] + 0.3 * RNG.normal(size=(120, 8))
    p[5] = 0
    gp = ["hot" if i < 220 else f"s{i % 9}" for i in range(300)]
    pp = ["hot" if i < 90 else f"s{i % 9}" for i in range(120)]
    return p, pp, g, gp


PLANS = {
    "broadcast": {}, "one_cell": {"broadcast_bytes": 0}, "blocks": {"broadcast_bytes": 0, "block_rows": 40},
    "cells": {"broadcast_bytes": 0, "cells": 6, "block_rows": 40}, "many_cells": {"broadcast_bytes": 0, "cells": 40, "block_rows": 16},
}


@pytest.mark.parametrize("plan", list(PLANS))
@pytest.mark.parametrize("k, t, cut", [(5, 0.2, "before"), (90, 1.1, "after")])
def test_knn_is_exact(spark, data, plan, k, t, cut):
    p, pp, g, gp = data
    got = search.knn_join(table(spark, p, pp, "probe_id"), table(spark, g, gp), k=k, threshold=t, cut=cut, carry=(), **PLANS[plan]).collect()
    assert {(r.probe_id, r["rank"], r.vec_id) for r in got} == brute(p, pp, g, gp, k, t, cut == "before")


def test_pivots_rule_out_cells(spark):
    """With separated clusters a probe visits few cells, and loses nothing."""
    centres = np.eye(8)
    g = np.repeat(centres, 50, axis=0) + 0.01 * RNG.normal(size=(400, 8))
    gal = table(spark, g, ["a"] * 400)
    placed = search._assign(gal, centres, ["domain"], 10, True)
    cells = placed.groupBy("domain", "_cell").agg(F.max("_radius").alias("_r"))
    routed = search._route(table(spark, g, ["a"] * 400, "probe_id"), cells, centres, ["domain"], reach=np.sqrt(2 * 0.1), nprobe=None)
    assert routed.count() == 400
    got = search.knn_join(table(spark, g, ["a"] * 400, "probe_id"), gal, k=3, threshold=0.1, carry=(), pivots=centres, block_rows=10)
    assert {(r.probe_id, r["rank"], r.vec_id) for r in got.collect()} == brute(g, ["a"] * 400, g, ["a"] * 400, 3, 0.1)


def test_constant_part_keeps_its_join_keys(spark, data):
    p, _, g, _ = data
    pr, ga = (table(spark, m, ["x"] * len(m), i).withColumn("domain", F.lit("all")) for m, i in ((p, "probe_id"), (g, "vec_id")))
    plan = search.knn_join(pr, ga, k=3, threshold=0.5, carry=(), broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ivf_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("domain", F.lit("all"))
    pr = e.withColumnRenamed("vec_id", "probe_id")
    exact = search.knn_join(pr, e, k=10, threshold=1.5, carry=())
    ivf = search.knn_join(pr, e, k=10, threshold=1.5, carry=(), method="ivf", cells=16, nprobe=12, block_rows=64)
    hit = exact.join(ivf, ["probe_id", "vec_id"], "left_semi").count()
    assert hit >= 0.9 * exact.count()


@pytest.mark.parametrize("plan", list(PLANS))
def test_neighbours_and_consensus(spark, data, plan):
    _, _, g, gp = data
    v = table(spark, g, gp)
    d = distances(g, g)
    same = np.array(gp)[:, None] == np.array(gp)[None, :]
    near = same & (d < 0.1)
    got = {r.vec_id: r for r in search.neighbour_stats(v, group="domain", threshold=0.1, **PLANS[plan]).collect()}
    other = near & ~np.eye(len(g), dtype=bool)
    for i in range(len(g)):
        n = int(near[i].sum())
        if n:
            assert got[i].neighbours == n
            assert got[i].min_distance == (pytest.approx(d[i][other[i]].min(), abs=1e-9) if other[i].any() else None)
        else:
            assert i not in got or got[i].neighbours == 0
    want = set()
    for p in set(gp):
        ids = [i for i in range(len(g)) if gp[i] == p]
        c = max(ids, key=lambda i: (near[i].sum(), -i))
        if near[c].sum() >= 4:
            want |= {(p, c, j) for j in ids if near[c, j]}
    found = search.consensus(v, group="domain", threshold=0.1, **PLANS[plan]).collect()
    assert {(r.domain, r.centre_id, r.vec_id) for r in found} == want


@pytest.mark.parametrize("plan", ["broadcast", "one_cell", "blocks"])
def test_validation(spark, data, plan):
    p, pp, g, gp = data
    got = {r.cand_id: r for r in search.validate_against(table(spark, p, pp, "cand_id"), table(spark, g, gp, "ref_idx"), on="domain", threshold=0.05, **PLANS[plan]).collect()}
    d = distances(p, g)
    assert len(got) == len(p)
    for i in range(len(p)):
        refs = [j for j in range(len(g)) if gp[j] == pp[i]]
        ok = [j for j in refs if d[i, j] < 0.05]
        assert got[i].min_distance == pytest.approx(min(d[i, j] for j in refs), abs=1e-9)
        assert got[i].first_passing_ref == (ok[0] if ok else None) and got[i].accepted == bool(ok)


def test_sql_functions(spark, sf):
    from vidspark.functions.sql import register_functions

    register_functions(spark)
    spark.read.parquet(f"{sf}/embeddings.parquet").createOrReplaceTempView("emb")
    r = spark.sql("SELECT cosine_distance(a.embedding, a.embedding) AS d, iou(0, 0, 100, 100, 50, 0, 150, 100) AS o, safe_name('Đorđe Čolić-Žan!') AS s FROM emb a LIMIT 1").first()
    assert r.d == pytest.approx(0, abs=1e-12) and r.o == pytest.approx(1 / 3) and r.s == "Djordje_Colic-Zan"


def test_default_cells_and_their_bound(spark, sf):
    """The default number of cells works for a small gallery; too many are refused, not cut."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("domain", F.lit("a"))
    p = e.withColumnRenamed("vec_id", "probe_id").select("probe_id", "domain", "embedding")
    few = search.knn_join(p.limit(5), e, k=1, threshold=0.5, method="ivf", carry=())
    assert few.count() == 5
    for method in ("exact", "ivf"):
        with pytest.raises(ValueError):
            search.knn_join(p, e, k=1, method=method, cells=search.MAX_CELLS + 1, carry=()).count()
    assert search.knn_join(p, e.limit(0), k=1, carry=()).count() == 0


def test_ivf_means_the_same_in_small_parts(spark, sf):
    """A part of one block is searched in its nearest cells only, like any other."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("domain", F.lit("a"))
    p = e.withColumnRenamed("vec_id", "probe_id").select("probe_id", "domain", "embedding")
    runs = [search.knn_join(p, e, k=20, threshold=2.0, method="ivf", cells=16, nprobe=1, block_rows=rows, carry=()).count() for rows in (64, 100_000)]
    assert runs[0] == runs[1] < search.knn_join(p, e, k=20, threshold=2.0, carry=()).count()


@pytest.mark.parametrize("method", ["exact", "ivf"])
def test_small_blocks_do_not_multiply_the_rows(spark, monkeypatch, method):
    """Rows sent to the block pairs: a few copies of each, however small the blocks and however many the cells."""
    g = RNG.normal(size=(3000, 8))
    gallery, probes = table(spark, g, ["a"] * 3000), table(spark, g, ["a"] * 3000, "probe_id")
    sent, spread = [], search.spread
    monkeypatch.setattr(search, "spread", lambda df, *keys: (sent.append(df.count()), spread(df, *keys))[1])
    got = search.knn_join(probes, gallery, k=1, threshold=0.9, carry=(), method=method, cells=20, nprobe=20, block_rows=10, broadcast_bytes=0)
    assert {(r.probe_id, r.vec_id) for r in got.collect()} == {(i, i) for i in range(3000)}
    assert sum(sent) <= 3000 * (search.GALLERY_STRIPS + search.PROBE_STRIPS + 2), sent


def test_hot_part_is_cut_whatever_its_ids(spark):
    """Rows of one id are still dealt to all strips of their part, and none is lost."""
    g = RNG.normal(size=(400, 8))
    gallery = table(spark, g, ["a"] * 400).withColumn("vec_id", F.lit(7).cast("long"))
    got = search.knn_join(table(spark, g[:50], ["a"] * 50, "probe_id"), gallery, k=400, threshold=3.0, carry=(), block_rows=20, broadcast_bytes=0)
    assert got.count() == 50 * 400


def test_ivf_searches_the_same_cells_in_strips(spark):
    """Some cells only: small strips, which cut cells, find what one strip does."""
    g = RNG.normal(size=(600, 6))
    gallery, probes, pivots = table(spark, g, ["a"] * 600), table(spark, g[:80] + 0.1, ["a"] * 80, "probe_id"), search._units(pd.Series(list(g[:9])))
    runs = []
    for rows in (10, 100_000):
        got = search.knn_join(probes, gallery, k=5, threshold=1.5, carry=(), method="ivf", pivots=pivots, nprobe=3, block_rows=rows, broadcast_bytes=0)
        runs.append({(r.probe_id, r["rank"], r.vec_id) for r in got.collect()})
    assert runs[0] == runs[1]


def test_distances_held_at_once_are_bounded():
    units = RNG.normal(size=(40_000, 4))
    p = pd.DataFrame({"embedding": list(RNG.normal(size=(700, 4)))})
    sizes = [d.size for _, d in search._chunks(p, units)]
    assert max(sizes) <= 2 << 20 and sum(sizes) == 700 * 40_000


@pytest.mark.parametrize("plan", ["broadcast", "blocks", "cells"])
def test_folds_of_all_matches(spark, plan):
    """Many images and persons, long and short runs of columns, persons missing."""
    g, p = RNG.normal(size=(420, 6)), RNG.normal(size=(90, 6))
    person = [None if i % 50 == 3 else 1 if i < 200 else i % 17 for i in range(420)]
    gallery = spark.createDataFrame([(i, "a", person[i], g[i].tolist()) for i in range(420)], "vec_id long, domain string, person_id long, embedding array<double>")
    probes = spark.createDataFrame([(i, "a", i // 7, float(i), p[i].tolist()) for i in range(90)], "probe_id long, domain string, image_id long, w double, embedding array<double>")
    got = search.match_folds(probes, gallery, threshold=0.8, within=1.0, thresholds=(0.3, 0.6, 0.9), first=("w",), **PLANS[plan]).collect()
    d, want = distances(p, g), {}
    for i in range(90):
        for j in range(420):
            if d[i, j] < 1.0:
                want.setdefault((i // 7, person[j]), []).append((i, d[i, j]))
    want = {k: v for k, v in want.items() if any(x < 0.8 for _, x in v)}
    assert {(r.image_id, r.person_id) for r in got} == set(want)
    for r in got:
        every = want[r.image_id, r.person_id]
        close = sorted(x for _, x in every if x < 0.8)
        assert r.n == len(close) and r.sum_distance == pytest.approx(sum(close)) and r.max_distance == close[-1] and list(r.lowest) == close[:3]
        assert [r.n_0, r.n_1, r.n_2] == [sum(x < t for x in close) for t in (0.3, 0.6, 0.9)] and r.w == float(min(i for i, _ in every))
