"""Vector codes over the trie of parts: brute force and awkward rows."""

import math
import random

import numpy as np
import pytest

from vidspark.llm import vector_codes as V
from vidspark.llm.part_trie import TOGETHER, nearest, nearest_of_any


def brute(parts, entries):
    far = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


@pytest.mark.parametrize(("n", "width", "span"), [(1, 4, 3), (500, 1, 9), (3000, 3, 4), (9000, 4, 12), (3 * TOGETHER, 2, 200)])
def test_trie_against_all_entries(n, width, span):
    rng = np.random.default_rng(n)
    parts = rng.integers(-span, span, (n, width))
    entries = rng.integers(-span, span, (17, width))
    entries[5] = entries[2]  # ties go to the lower index
    chosen, far = nearest_of_any(parts, entries)
    want = brute(parts, entries)
    assert (chosen == want[0]).all() and (far == want[1]).all() and 5 not in chosen
    distinct = np.unique(parts, axis=0)
    assert (nearest(distinct, entries)[0] == brute(distinct, entries)[0]).all()
    assert len(nearest_of_any(parts[:0], entries)[0]) == 0


def plain(rows, parts, entries, rounds, scale=256):
    """Codes, errors and label errors of (vec_id, vector, label), one vector at a time."""
    ok = [(i, [max(-V.LIMIT, min(V.LIMIT, math.floor(x * scale))) for x in v], lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    size = len(ok[0][1])
    ok, first = [r for r in ok if len(r[1]) == size], {}
    for i, v, _ in ok:
        first.setdefault(i, v)
    first, width = list(first.values())[:entries], size // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, v, _ in ok:
                groups.setdefault(near(p, cut(v, p))[1], []).append(cut(v, p))
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    out = [(i, lab, [near(p, cut(v, p)) for p in range(parts)]) for i, v, lab in ok]
    error = {}
    for _, lab, found in out:
        error[lab] = error.get(lab, 0) + sum(f[0] for f in found)
    return sorted(((i, lab, [f[1] for f in found], sum(f[0] for f in found), error[lab]) for i, lab, found in out), key=repr), books


def frame(spark, rows):
    clash = [(*r, 1, 2, "x", 3) for r in rows]
    return spark.createDataFrame(clash, "vec_id long, embedding array<float>, label int, codes int, error long, _whole string, position int")


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(2, 5, 2), (4, 64, 1), (1, 3, 0)])
def test_codes_against_plain(spark, parts, entries, rounds):
    rng = random.Random(parts)
    rows = [(k, [round(rng.uniform(-0.1, 0.1), 3) for _ in range(4)], rng.choice([1, 2, None])) for k in range(120)]
    rows += rows[:7] + [(3, [9.0, -9.0, 0.5, 1e30], 1), (None, [0.1, 0.2, 0.3, 0.4], 7), (-1, None, 1), (-2, [0.1, None, 0.1, 0.1], 1), (-3, [float("nan")] * 4, 1), (-4, [float("-inf"), 0.0, 0.0, 0.0], 2), (900, [0.5] * 8, 2), (901, [], None), (902, [0.1] * 3, 4)]
    rows = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, lab) for i, v, lab in rows]
    got, books = V.compressed(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    want, want_books = plain(rows, parts, entries, rounds)
    assert sorted(map(tuple, got.select("vec_id", "label", "codes", "error", "label_error").collect()), key=repr) == want
    assert books.tolist() == want_books


def test_hot_vector_and_ids(spark):
    """A third of the rows is one vector, another third one id."""
    rows = [(k, [0.25, -0.25], 5) for k in range(300)] + [(7, [k / 300, 0.5], k % 90) for k in range(300)] + [(1000 + k, [k / 100, -k / 50], None) for k in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got, _ = V.compressed(frame(spark, rows), parts=2, entries=16)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, 2, 16, 2)[0]


def test_nothing_left(spark):
    for rows in ([], [(1, None, 2), (2, [float("nan")] * 4, 1)]):
        got, books = V.compressed(frame(spark, rows), parts=2)
        assert got.collect() == [] and books is None and got.columns == ["vec_id", "label", "codes", "error", "label_error"]
    assert V.digest(None) == V.digest(np.zeros((0, 0, 0), dtype=np.int64))
