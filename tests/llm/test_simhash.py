import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from tests.llm.cases import AWKWARD, awkward, empty
from vidspark.llm import bk_forest, bk_tree, simhash
from vidspark.llm.queries import QUERIES


def plain_print(text, k):
    w = [x for x in (text or "").encode().lower().split()]
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hs = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, radius):
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_tree_against_all_pairs(radius):
    rng = random.Random(radius)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(8)]
    prints = sorted(set(prints))
    got = bk_tree.linked(np.zeros(len(prints), dtype=np.int64), np.array(prints, dtype=np.uint64), radius, block=7)
    assert list(got) == plain_components(prints, radius)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    docs.sort(key=lambda r: r["doc_id"])
    prints = [plain_print(r["text"], 3) for r in docs]
    root = plain_components(prints, 2)
    want = {(r["doc_id"], f"{p:016x}", docs[c]["doc_id"]) for r, p, c in zip(docs, prints, root, strict=True)}
    assert {tuple(r) for r in QUERIES["op8_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want


@pytest.mark.parametrize("limit", [3, 1000])
@pytest.mark.parametrize("radius", [2, 3])
def test_hot_shards_are_cut_without_losing_links(spark, limit, radius):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    root = plain_components(prints, radius)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, 0, p) for i, p in enumerate(signed)], "doc_id long, text_hash long, fp long")
    got = {r["fp"]: r["low"]["doc_id"] for r in simhash.components(df, radius=radius, limit=limit).collect()}
    assert [got[p] for p in signed] == root


@pytest.mark.parametrize("limit", [1, 20, 4096])
def test_hot_sketch_shards_lose_no_link(spark, limit):
    """All share one min-hash and no other, as under a common passage; pairs lie up to 9 bits apart."""
    rng = random.Random(7)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(6, 11))) for _ in range(3)]
    prints = list(dict.fromkeys(prints))
    root = plain_components(prints, 9)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, 0, p, [77, *(1000 + 4 * i + k for k in range(4))]) for i, p in enumerate(signed)], "doc_id long, text_hash long, fp long, mins array<long>")
    got = {r["fp"]: r["low"]["doc_id"] for r in simhash.components(df, radius=9, shards="sketch", limit=limit).collect()}
    assert [got[p] for p in signed] == root


def test_awkward_rows(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    groups = {}
    for r in got:
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(map(repr, groups[1])) == ["1", "2", "2", "None"]
    assert sorted(groups[3]) == [3, 4, 5]
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    kept = simhash.first_of_groups(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 2, 3, 6, 8, 9] or sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 8, 9]


def test_wide_radius_by_sketches(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = []
    for k in range(20):
        words = [rng.choice(vocabulary) for _ in range(400)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:200], "changed", *words[201:]]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for limit in (1, 100):
        kept = {r["doc_id"] for r in simhash.first_of_groups(docs, limit=limit).collect()}
        assert {2 * k for k in range(20)} <= kept and len(kept) <= 22


def test_shingles():
    one = partial(simhash.shingle_hashes, words=3)
    assert len(one(b"")) == 0 and len(one(b"A b")) == 1 and len(one(b"a b c d")) == 2
    assert one(b"A b")[0] == xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("radius", [2, 9, 13])
@pytest.mark.parametrize("held", [5, 1_000_000])
def test_nearest_forest_against_all_pairs(radius, held):
    rng = random.Random(radius)
    prints, shard = [], []
    for s in range(3):
        here = set()
        for _ in range(25):
            base = rng.getrandbits(64)
            here |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 14))) for _ in range(6)}
        prints += sorted(here)
        shard += [s] * len(here)
    a, b = bk_forest.forest(np.array(shard), np.array(prints, dtype=np.uint64), radius, block=7, width=50, held=held)
    # the weight of a minimum spanning forest is unique: one by one, nearest pairs first
    label = list(range(len(prints)))
    pairs = sorted((bin(prints[i] ^ prints[j]).count("1"), i, j) for i in range(len(prints)) for j in range(i) if shard[i] == shard[j])
    want = []
    for d, i, j in pairs:
        if d <= radius and label[i] != label[j]:
            want.append(d)
            x, y = label[i], label[j]
            label = [x if k == y else k for k in label]
    assert sorted(bin(prints[i] ^ prints[j]).count("1") for i, j in zip(a, b, strict=True)) == want


def jaccard(a, b, k=5):
    one, two = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("limit", [1, 16_384])
def test_stage_links_what_is_alike_and_nothing_else(spark, limit):
    """Pairs of a Jaccard similarity from 0.7 to 0.95, each pair of texts of its own, all with one common passage."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    rows, real = [], {}
    for k in range(300):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((120, 400)))] + passage
        other = list(base)
        for _ in range(round(len(base) * rng.choice((0.005, 0.01, 0.015, 0.02, 0.025, 0.03)))):
            other[rng.randrange(len(base))] = f"x{rng.randrange(10_000)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        real[k] = jaccard(rows[-2][1], rows[-1][1])
    kept = {r["doc_id"] for r in simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit=limit).collect()}
    gone = {k for k in real if 2 * k + 1 not in kept}
    assert all(2 * k in kept for k in real)
    assert all(real[k] >= 0.8 for k in gone)
    alike = [k for k in real if real[k] >= 0.8]
    close = [k for k in alike if real[k] < 0.85]
    assert len(close) > 40 and len([k for k in real if real[k] < 0.8]) > 40
    assert len(gone) >= 0.95 * len(alike) and len(gone.intersection(close)) >= 0.9 * len(close)


def test_crowd_of_copies_leaves_one(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(i, " ".join([*base[:at], f"n{i}", *base[at + 1 :]])) for i, at in ((i, rng.randrange(300)) for i in range(3000))]
    kept = [r["doc_id"] for r in simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert kept == [0]


def test_stage_loses_no_link(spark):
    """Groups of texts of 40 to 400 words, many pairs close to the threshold and one passage in all, against all pairs."""
    rng = random.Random(23)
    passage, texts = [f"p{i}" for i in range(20)], []
    for _ in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((20, 120, 380)))] + passage
        texts.append(base)
        for _ in range(4):
            other = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, max(1, len(other) // 35))):
                other[rng.randrange(len(other))] = f"x{rng.randrange(10_000)}"
            texts.append(other[: len(other) - rng.choice((0, 0, 1, len(other) // 6))])
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(1000, ""), (1001, " "), (1002, None)]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for _, t in rows)]
    low = list(range(len(rows)))
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    for _ in rows:
        for i, j in alike:
            low[i] = low[j] = min(low[i], low[j])
    want = {rows[k][0] for k in range(len(rows)) if low[k] == k}
    assert 100 < len(want) < 260
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.first_of_groups(docs).collect()} == want


def test_pairs_across_groups_only():
    """Of a key's texts, those of one group are not paired; sizes that cannot fit are left out."""
    rows = pa.RecordBatch.from_pydict({"key": [1, 1, 1, 1, 2], "text_hash": [10, 11, 12, 13, 10], "size": [50, 50, 50, 100, 50], "place": [0] * 5, "label": [5, 5, 6, 7, 5]})
    pairs = lambda first: [tuple(r.values()) for b in simhash._across(iter([rows.slice(0, 2), rows.slice(2)]), 0.8, first) for r in b.to_pylist()]
    assert pairs(False) == [(10, 12), (11, 12)] and pairs(True) == [(10, 12)]


def test_parity_bits_bound_the_difference():
    """Never more bits than shingles differ, in any mix of widths; and few shingles fall together."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 100, 130, 500, 1000, 5000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets += [base, np.unique(np.r_[base[n // 10 :], rng.integers(0, 2**63, n // 10, dtype=np.uint64)])]
    apart = simhash._apart([simhash.parities(x) for x in sets])
    for i, x in enumerate(sets):
        got = apart(i, np.arange(len(sets)))
        real = [len(np.setxor1d(x, y)) for y in sets]
        assert all(got <= real) and got[i] == 0
        if 100 <= len(x) <= 1000:
            assert got[i ^ 1] > 0.6 * real[i ^ 1]


def test_pairs_of_a_crowd_are_sifted(spark):
    """Copies of one text with five words changed in each are not alike in pairs, yet share keys that do not rule this
    out: the pairs that are compared do not grow with the square of the crowd, and brute force leaves the same texts."""
    rng = random.Random(31)
    base, rows = [f"p{i}" for i in range(300)], []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(5, 295, 6), 5):
            words[at] = f"x{rng.randrange(10**7)}"
        rows.append((k, " ".join(words)))
    rows += [(300 + k, rows[k][1] + " end") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = []
    before = simhash.compared
    try:
        simhash.compared = lambda d, pairs, **o: (asked.append(pairs.count()), before(d, pairs, **o))[1]
        kept = {r["doc_id"] for r in simhash.first_of_groups(docs).collect()}
    finally:
        simhash.compared = before
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    low = list(range(len(rows)))
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    for _ in range(5):
        for i, j in alike:
            low[i] = low[j] = min(low[i], low[j])
    assert kept == {k for k in range(len(rows)) if low[k] == k} and len(kept) > 100
    assert sum(asked[1:]) < 10_000
