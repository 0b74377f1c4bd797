"""Importance resampling and its radix sort: plain loops and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import AWKWARD, LONG, awkward, empty
from vidspark.llm import resampling
from vidspark.llm.radix_sort import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets):
    w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [" ".join(p) for p in zip(w, w[1:])]]


def plain(docs, target, share, least, buckets):
    found = [(d, *features(t, buckets)) for d, t in docs]
    s, t = Counter(b for r in found for b in r[2]), Counter(b for x in target for b in features(x, buckets)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(sum(s.values()) + buckets) / ((s[b] + 1) * float(sum(t.values()) + buckets))))
    rows = []
    for d, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = len(order) * share // 100
    return sorted([(*r, k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r, None) for r in rows if r[1] < least], key=repr)


def test_against_plain(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["One", "two", "ünï", "x-y", "4th", "\n"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 50))) for _ in range(150)]
    docs = [(rng.choice([k, k - 40, None]), t) for k, t in enumerate(texts)]
    docs += docs[:20] + [(None, None), (5, "")] + [(k, texts[149]) for k in range(1000, 1080)]
    target = [*texts[:5], None, ""]
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), share=40, least=10, buckets=97)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, 40, 10, 97)


@pytest.mark.parametrize("extra", [True, False])
def test_awkward(spark, extra):
    docs, target = awkward(spark, extra), spark.createDataFrame([("the same text",)], "text string")
    got = resampling.resampled(docs, target, share=60, least=3).collect()
    assert sorted(map(tuple, got), key=repr) == plain([r[:2] for r in AWKWARD], ["the same text"], 60, 3, 10000)
    drawn = resampling.drawn_documents(docs, target, share=60, least=3)
    assert drawn.columns == docs.columns
    assert Counter(r["doc_id"] for r in drawn.collect()) == Counter(r["doc_id"] for r in got if r["rank"])
    nothing = empty(spark).select("text")
    assert resampling.resampled(empty(spark), target).collect() == [] and resampling.drawn_documents(empty(spark), target).collect() == []
    assert len(resampling.resampled(docs, nothing).collect()) == len(AWKWARD)
    assert max(r["n_words"] for r in got) == len(LONG.split()) + 1


@pytest.mark.parametrize(("rows_each", "counts"), [(500_000, 1 << 20), (70, 64), (1, 2)])
def test_radix_ranks(spark, rows_each, counts):
    rng = random.Random(rows_each)
    n, far = (20, 3) if rows_each == 1 else (2000, 2**62 if rows_each > 1000 else 50)
    data = [(rng.choice([7, 7, 7, rng.randint(-5, 5), rng.randint(-far, far), None]), rng.choice([rng.randint(0, far % 300), 11, None]), k) for k in range(n)]
    df = spark.createDataFrame(data, "a long, b long, k long").repartition(5)
    got = ranked(df, [("a", True), ("b", False)], rows_each=rows_each, counts=counts).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, n + 1))
    key = lambda r: (r["a"] is None, -(r["a"] or 0), r["b"] is None, r["b"] or 0)
    assert [key(r) for r in sorted(got, key=lambda r: r["rank"])] == sorted(map(key, got))


def test_radix_of_one_value_and_of_nothing(spark):
    same = spark.range(50).withColumn("a", F.lit(3).cast("long"))
    assert sorted(r["rank"] for r in ranked(same, [("a", False)]).collect()) == list(range(1, 51))
    nulls = same.withColumn("a", F.lit(None).cast("long"))
    assert sorted(r["rank"] for r in ranked(nulls, [("a", True)]).collect()) == list(range(1, 51))
    assert ranked(same.limit(0), [("a", False)]).collect() == []
    ends = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,), (None,)], "a long")
    assert [r["a"] for r in ranked(ends, [("a", True)]).orderBy("rank").collect()] == [2**63 - 1, 0, -(2**63), None]
