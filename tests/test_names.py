"""Name functions, fuzzy candidates and merges against brute force."""

import itertools
import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vidspark.functions import names as N
from vidspark.operators import graph, naming, workflow

SYL = ["ma", "ri", "ja", "ko", "vi", "pe", "tar", "lo", "na", "st", "ev", "an"]


def people(rng, n):
    out = set()
    while len(out) < n:
        name = " ".join("".join(rng.choice(SYL) for _ in range(rng.randint(1, 4))).capitalize() for _ in range(2))
        out.add(name)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(name))
            out.add((name[:i] + name[i + 1 :], name[:i] + rng.choice("aeiš") + name[i:], name[0].lower() + name[1:], name + " Jr.", name[:i] + name[i:][:1].upper() + name[i + 1 :])[rng.randrange(5)])
    return sorted(x for x in out if x.strip())


def norm(name):
    import re

    s = re.sub(r"\s+(jr|sr|ii|iii|iv)\.?$", "", name.lower().strip())
    for a, b in N.COMPARE_FOLD:
        s = s.replace(a, b)
    return s


def ratio(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    return 100.0 if a == b else SequenceMatcher(None, a, b).ratio() * 100


@pytest.fixture(scope="module")
def names():
    return people(random.Random(11), 260)


def frame(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "person_id long, name string")


def test_folding_is_the_compatibility_decomposition(spark):
    """Every character of Unicode, and texts of several."""
    chars = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isprintable() and c < 0x3000 or unicodedata.decomposition(chr(c)))]
    texts = [*chars, "ﬁne Ａna x™ Ⅳ", "Ａｎａ ﬁ", "Ĳ㎏ℬ𝒜①½", "Ж日本 a", "e\u0301", ""]
    rows = spark.createDataFrame([(c,) for c in texts], "c string").select("c", N.to_ascii(F.col("c")).alias("jvm")).collect()
    assert {r.c: r.jvm for r in rows} == {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in texts}
    got = spark.createDataFrame([("ﬁne",), ("Ａna",), ("x™",), ("Ⅳ",)], "c string").select(N.safe_name(F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == ["fine", "Ana", "xTM", "IV"]


@pytest.mark.parametrize(("ratio", "most"), [(0.7, 0.2), (0.8, 0.02), (0.9, 0.005)])
def test_joined_rows_of_a_growing_list(spark, ratio, most):
    """The share of all pairs that the keys bring together is small and does not grow with the list."""
    rng, syllables, shares = random.Random(4), [c + v for c in "bcdfghjklmnprstvz" for v in "aeiou"], []
    for n in (400, 3200):
        forms = {" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(2)) for _ in range(n)}
        df = spark.createDataFrame([(x,) for x in sorted(forms)], "form string")
        shares.append(naming.met_pairs(df, df, ratio=ratio).count() / n / n)
    assert shares[1] < most and shares[1] < max(1.1 * shares[0], 0.002), shares


@pytest.mark.parametrize("threshold", [90.0, 85.0, 80.0, 70.0, 60.0])
def test_blocking_loses_no_similar_pair(spark, names, threshold):
    want = {(a, b) for a, b in itertools.permutations(names, 2) if ratio(norm(a), norm(b)) >= threshold}
    got = naming.similar_names(frame(spark, names), threshold=threshold).collect()
    assert {(r.source, r.target) for r in got} == want


def test_merge_scan_equals_the_cascade(spark, names):
    spelling, nick = (("mar", "ste"), ("kov", "pet")), (("ma", "koko"), ("mari", "vipe"))
    names = sorted({*names, "Ma Petar", "Koko Petar", "Koko Petark", "Mari Lona"})
    want, done = {}, set()
    for n in names:
        rest = [o for o in names if o != n]
        if n[0].islower():
            hits = [o for o in rest if ratio(norm(n), norm(o)) >= 70]
            want[(n, hits[0] if hits else None)] = "TYPO"
            continue
        pick = next(((o, i, s) for o in rest for i, (a, b) in enumerate(spelling) for s, (x, y) in enumerate(((a, b), (b, a))) if x in n.lower() and y in o.lower()), None)
        kind = "SPELLING_VARIANT"
        if pick is None:
            kind, p = "NICKNAME", n.lower().split()
            pick = next(((o,) for o in rest for a, b in nick if len(p) > 1 and len(o.split()) > 1 and p[0] == a and o.lower().split()[0] == b and ratio(p[-1], o.lower().split()[-1]) > 80), None)
        if pick is not None:
            key = tuple(sorted((n, pick[0])))
            if key not in done:
                done.add(key)
                want[(n, pick[0])] = kind
            continue
        for o in rest:
            key = tuple(sorted((n, o)))
            if key not in done and ratio(norm(n), norm(o)) >= 90:
                done.add(key)
                want[(n, o)] = "DUPLICATE"
    got = naming.merge_candidates(frame(spark, names), rules=naming.MergeRules(spelling=spelling, nicknames=nick))
    assert {(r.source, r.target): r.type for r in got.collect()} == want
    order = [r.type for r in naming.in_report_order(got).collect()]
    assert order == sorted(order, key=["TYPO", "DUPLICATE", "SPELLING_VARIANT", "NICKNAME"].index)


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(root)}


def test_groups_on_chains_stars_and_random_links(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5000, 5000)]
    got = graph.connected_groups(spark.createDataFrame(edges, "a long, b long"), a="a", b="b").collect()
    assert {r.id: r.root for r in got} == components(edges)


def test_merge_chains_end_where_nothing_is_merged(spark):
    d = [(1, 2), (2, 3), (3, 10), (4, 10), (7, 8), (8, 7)]
    got = graph.resolve_merges(spark.createDataFrame(d, "source_id long, target_id long")).collect()
    assert {r.source_id: r.target_id for r in got} == {1: 10, 2: 10, 3: 10, 4: 10, 8: 7}


def test_decisions_applied_twice_change_nothing_more(spark):
    persons = spark.createDataFrame([(i, f"p{i}") for i in range(1, 7)], "person_id long, name string")
    vectors = spark.createDataFrame([(i, i * 10) for i in range(1, 7)], "person_id long, vec_id long")
    dec = spark.createDataFrame([(1, "MERGE", 2, None), (2, "MERGE", 3, None), (4, "DELETE", None, None), (5, "RENAME", None, "new"), (6, "SKIP", None, None)], "source_id long, action string, target_id long, new_name string")
    p, v = workflow.apply_decisions(persons, vectors, dec)
    want_p, want_v = {(3, "p3"), (5, "new"), (6, "p6")}, {(3, 10), (3, 20), (3, 30), (5, 50), (6, 60)}
    assert {(r.person_id, r.name) for r in p.collect()} == want_p and {(r.person_id, r.vec_id) for r in v.collect()} == want_v
    p2, v2 = workflow.apply_decisions(p, v, dec)
    assert {(r.person_id, r.name) for r in p2.collect()} == want_p and {(r.person_id, r.vec_id) for r in v2.collect()} == want_v


def test_equal_forms_need_no_search(spark):
    """At 100 % only equal forms are similar, so no keys are made and joined."""
    people = spark.createDataFrame([("Ana Kos",), ("ANA KOS",), ("Ana Kosa",), ("Iva",)], "name string")
    found = naming.similar_names(people, threshold=100.0)
    assert {(r.source, r.target, r.similarity) for r in found.collect()} == {("Ana Kos", "ANA KOS", 100.0), ("ANA KOS", "Ana Kos", 100.0)}
    assert "levenshtein" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_computed_once(spark, names):
    """No rule reads the rows that the names come from again, nor tests them there."""
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name

    people = frame(spark, names).repartition(2).withColumn("name", F.udf(counted, "string")("name"))
    assert naming.merge_candidates(people).count() > 0
    assert seen.value == len(names)
    assert naming.similar_names(people, threshold=90.0).count() > 0
    assert seen.value == 2 * len(names)
