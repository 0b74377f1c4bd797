"""The stored vector index: exact at all cells, recall, inserts, pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_search import brute, table
from vidspark.operators import index as I

RNG = np.random.default_rng(12)


def clustered(n, centres, spread):
    return centres[RNG.integers(0, len(centres), n)] + spread * RNG.normal(size=(n, centres.shape[1]))


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 50}])
def test_all_cells_are_exact(spark, tmp_path, options):
    centres = RNG.normal(size=(5, 8))
    g, p = clustered(400, centres, 0.4), clustered(60, centres, 0.4)
    g[:80] = g[0]  # copies share one cell
    g[90:93] = 0
    gp, pp = ["hot" if i < 300 else f"s{i % 5}" for i in range(400)], ["hot" if i < 40 else f"s{i % 5}" for i in range(60)]
    rows = table(spark, g, gp)
    ragged = spark.createDataFrame([(9001, "hot", [1.0]), (9002, "hot", None)], rows.schema)
    built = I.build_index(rows.filter("vec_id < 250").unionByName(ragged), str(tmp_path / "i"), cells=30, carry=())
    I.insert(built, rows.filter("vec_id >= 250"))
    index = I.open_index(spark, str(tmp_path / "i"), carry=())
    assert (index.fine == built.fine).all() and (index.coarse == built.coarse).all() and (index.owner == built.owner).all()
    assert index.rows(spark).count() == 400
    got = I.search_index(index, table(spark, p, pp, "probe_id"), k=7, threshold=0.9, nprobe=index.cells, **options).collect()
    assert {(r.probe_id, r["rank"], r.vec_id) for r in got} == brute(p, pp, g, gp, 7, 0.9)


def test_recall_grows_with_cells_and_prunes(spark, tmp_path):
    """Probes drawn anew from the same clusters, not copies of stored rows."""
    centres = RNG.normal(size=(40, 16))
    g, p = clustered(6000, centres, 0.5), clustered(200, centres, 0.5)
    gallery, probes = table(spark, g, ["x"] * 6000), table(spark, p, ["x"] * 200, "probe_id")
    index = I.build_index(gallery, str(tmp_path / "i"), cells=64, carry=())
    want = {(a, b) for a, _, b in brute(p, ["x"] * 200, g, ["x"] * 6000, 10, 2.0)}
    recall = []
    for nprobe in (1, 8, 24):
        got = I.search_index(index, probes, k=10, threshold=2.0, nprobe=nprobe).collect()
        recall.append(len(want & {(r.probe_id, r.vec_id) for r in got}) / len(want))
    assert recall == sorted(recall) and recall[1] > 0.6 and recall[2] > 0.9, recall
    one = I.search_index(index, probes.limit(1), k=3, threshold=2.0, nprobe=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_cell" in plan or "_cell#" in plan.split("PartitionFilters")[1][:80]


def test_more_cells_than_the_unstored_search_allows(spark, tmp_path):
    g = RNG.normal(size=(3000, 4))
    index = I.build_index(table(spark, g, ["x"] * 3000), str(tmp_path / "i"), cells=1500, carry=())
    assert index.cells > 1024
    got = I.search_index(index, table(spark, g[:20], ["x"] * 20, "probe_id"), k=1, threshold=0.5, nprobe=4).collect()
    assert {(r.probe_id, r.vec_id) for r in got} == {(i, i) for i in range(20)}
    with pytest.raises(ValueError):
        I.build_index(table(spark, g, ["x"] * 3000), str(tmp_path / "j"), cells=1 << 24, carry=())


def test_empty(spark, tmp_path):
    g = table(spark, RNG.normal(size=(10, 4)), ["x"] * 10)
    index = I.build_index(g, str(tmp_path / "i"), cells=4, carry=())
    none = g.limit(0).withColumnRenamed("vec_id", "probe_id")
    assert I.search_index(index, none, k=3).collect() == []
    few = I.search_index(index, g.withColumnRenamed("vec_id", "probe_id"), k=1, threshold=0.5, nprobe=4)
    assert few.count() == 10
