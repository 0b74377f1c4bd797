"""Repeated spans, language-model scores, languages, the pipeline: brute force and awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter
from functools import partial
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.cases import AWKWARD, awkward, empty
from vidspark.llm import context_tables, language_id, substrings, suffix_tree
from vidspark.llm.queries import QUERIES
from vidspark.session import checkpoint_root


# repeated spans

def plain_rest(docs, window):
    first = {}
    for d, text in docs:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d is None, d)), (d is None, d))
    out = []
    for d, text in docs:
        w = (text or "").encode().split()
        gone = {i + o for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (d is None, d) for o in range(window)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("window", "anchor"), [(50, 20), (6, 3), (4, 4)])
def test_spans_against_all_windows(spark, window, anchor):
    rng = random.Random(window)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(3, 120))] for k in range(6)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            low = rng.randint(0, len(p) - 1)
            w += [f"x{rng.randint(0, 30)}" for _ in range(rng.randint(0, 20))] + p[low:] if rng.random() < 0.8 else p * 2
        docs.append((d if d % 9 else None, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += docs[:5] + [(100, None), (101, "")]
    got = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=window, anchor=anchor)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == plain_rest(docs, window)


def test_spans_awkward(spark):
    got = substrings.without_repeats(awkward(spark)).collect()
    assert Counter(tuple(r) for r in got) == plain_rest([r[:2] for r in AWKWARD], 50)
    assert substrings.without_repeats(empty(spark)).collect() == []


def test_paths_carry_both_coordinates(spark):
    shared = [f"s{i}" for i in range(80)]
    docs = [(1, " ".join(["a", "b", *shared])), (2, " ".join([*shared, "c"])), (3, " ".join(["d", *shared[10:70], "e"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    profile = df.selectExpr("doc_id", "xxhash64(text) text_hash", "text _text").mapInArrow(lambda b: substrings._anchors(b, 50, 20), "doc_id long, text_hash long, n_words long, sha256 string, anchors array<long>")
    spans = substrings.repeated_spans(df, profile, window=50, anchor=20, id_col="doc_id", text_col="text").select("doc_id", "start", "end", "source_id", "source_start").collect()
    assert sorted(map(tuple, spans)) == [(2, 0, 80, 1, 2), (3, 1, 61, 1, 12)]


def test_sliding_and_rolling():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 31, 64):
        view = np.lib.stride_tricks.sliding_window_view(x, width)
        assert (substrings.sliding(x, width) == view.min(1)).all() and (substrings.sliding(x, width, least=False) == view.max(1)).all()
    y = np.concatenate([x, x[3:90]])
    r = substrings.rolling(y, 20, substrings.BASES[0])
    assert len(r) == len(y) - 19 and (r[3:70] == r[200:267]).all() and len(set(r.tolist())) == len(r) - 68


# language model

def test_scores_against_counts(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    counts = Counter(x for d, w in docs.items() if not held[d] for x in w)
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in suffix_tree.scored(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    whole = {r["doc_id"]: r for r in QUERIES["op7_suffix_tree"](spark, sf).collect()}
    assert set(rows) == set(docs)
    base = tree = 0
    for d, w in docs.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert whole[d]["score"] == pytest.approx(r["score"])
        if held[d]:
            base, tree = base + r["base_score"], tree + r["score"]
    assert tree > base


def test_tree_keeps_contexts_that_tell_something(spark):
    texts = spark.createDataFrame([("ab cd " * 200,), ("ab cd " * 200,)], "_text string")
    words, (child, logs, once), n, v = suffix_tree.model_of(texts, least=1e-3)
    assert (n, v) == (802, 3)
    assert np.allclose((10.0 ** logs.astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    sure = suffix_tree.byte_logs(suffix_tree.stream([b"ab", b"cd", b"ab"]), child, logs)
    assert sure[1] > -0.05 and sure[4] > -0.05  # b behind a, d behind c
    none = suffix_tree.build([])
    assert np.allclose(none[1], math.log10(1 / 256))


def test_scores_awkward(spark):
    rows = suffix_tree.scored(awkward(spark)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((x[0], len((x[1] or "").encode().split()) + 1) for x in AWKWARD)
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert suffix_tree.scored(empty(spark)).collect() == []


def test_tree_beats_its_own_root(spark, sf):
    """On held-out texts, the same smoothing with contexts of two words, of one, of none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none, one, two = (sum(r["score"] for r in suffix_tree.scored(docs, order=k).filter("held_out").collect()) for k in (0, 1, 2))
    assert two > one > none and two - none > 0.05 * abs(none)


def test_scores_follow_contexts_and_spellings(spark):
    """Rare contexts count (aa is 12 of 60,000 positions); unseen words differ by context and spelling."""
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:5]
    train = [k for k in range(200) if k not in ids and zlib.crc32(str(k).encode()) % 7 != 2][:2]
    asked = ["aa bb", "bb aa", "w1 w7x", "aa w7x", "aa zq\u00e9\u2713"]
    texts = [(train[0], " ".join(f"w{k % 500}" for k in range(60_000))), (train[1], "aa bb cc " * 12), *zip(ids, asked, strict=True)]
    got = {r["doc_id"]: r for r in suffix_tree.scored(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    rows = [got[k] for k in ids]
    assert [r["n_known"] for r in rows] == [3, 3, 2, 2, 2]
    assert rows[0]["score"] > rows[1]["score"] + 1
    one = {r["doc_id"]: r["score"] for r in suffix_tree.scored(spark.createDataFrame(texts, "doc_id long, text string"), order=0).collect()}
    assert rows[2]["score"] - one[ids[2]] != pytest.approx(rows[3]["score"] - one[ids[3]], abs=0.1)
    assert rows[3]["score"] == pytest.approx(rows[4]["score"]) and rows[3]["spelled_score"] > rows[4]["spelled_score"] + 1


def plain_tree(texts, asked):
    """Natural logs of the probabilities of all tokens of `asked`, counted and tested in plain loops."""
    split = lambda t: [None, None, *(t or "").encode().lower().split(), b"\n"]
    one = Counter(x for t in texts for x in split(t)[2:])
    n, once = sum(one.values()), max(sum(c == 1 for c in one.values()), 1)
    follow = [{}, {}]
    for t in texts:
        w = split(t)
        for k in range(2, len(w)):
            follow[0].setdefault((w[k - 1],), Counter())[w[k]] += 1
            follow[1].setdefault((w[k - 2], w[k - 1]), Counter())[w[k]] += 1
    share = lambda c, x: c[x] / sum(c.values())

    def passes(c, parent):
        return sum(c.values()) >= 2 and sum(m * math.log(share(c, x) / parent(x)) for x, m in c.items()) > 0.5 * len(c) * math.log(n)

    two = {u for u, c in follow[1].items() if passes(c, lambda x, u=u: share(follow[0][u[1:]], x))}
    kept = {u for u, c in follow[0].items() if passes(c, lambda x: one[x] / n)} | {u[1:] for u in two}

    def p(x, u, v):
        out = (one[x] or once) / (n + once)
        for context, states, counts in (((v,), kept, follow[0]), ((u, v), two, follow[1])):
            if context in states:
                c = counts[context]
                out = (c[x] + len(c) * out) / (sum(c.values()) + len(c))
        return out

    return [sum(math.log10(p(w[k], w[k - 2], w[k - 1])) for k in range(2, len(w))) for w in map(split, asked)], len(kept), len(two)


def test_scores_against_a_plain_tree(spark):
    """The whole score, and that the test both keeps and drops contexts."""
    rng = random.Random(8)
    phrases = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(5)) for _ in range(25)]
    texts = {k: " ".join(rng.choice(phrases) if rng.random() < 0.7 else rng.choice("xyz") + str(rng.randint(0, 400)) for _ in range(rng.randint(0, 25))) for k in range(120)}
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    want, one, two = plain_tree([t for k, t in texts.items() if k not in held], texts.values())
    got = {r["doc_id"]: r["score"] for r in suffix_tree.scored(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[k] for k in texts] == pytest.approx(want) and one > 20 and two > 10
    assert two < len({x for t in texts.values() for x in zip(t.split(), t.split()[1:])}) / 3


def test_probabilities_add_up(spark):
    """After any context, seen or not, the training tokens and the one other symbol share 1."""
    texts = ["a b a c a b d b a " * 3, "b c b a d d a b"]
    names = ["a", "b", "c", "d", "\n", "other"]
    asked = [f"{u} {v} {w}" for u in "abcd" for v in "abcd" for w in ("a", "b", "c", "d", "other")] + [f"{u} {v}" for u in "abcd" for v in "abcd"]
    rows = spark.createDataFrame([(t, False) for t in texts] + [(t, True) for t in asked], "_text string, held_out boolean")
    words, (child, logs, once), n, v = suffix_tree.model_of(rows)
    assert (n, v) == (27 + 8 + 2, 5)
    spelled = words.mapInArrow(partial(suffix_tree._spell, model=spark.sparkContext.broadcast((child, logs))), "w long, c long, spelled double")
    p = {r["t"]: math.exp(r["p"]) for r in suffix_tree.probabilities(rows, spelled, n=n, once=once).collect()}
    key = lambda *w: int(suffix_tree._keys(np.array([suffix_tree.xxh64_intdigest(x.encode()) for x in w], dtype=np.uint64)).view(np.int64)[0])
    for u in "abcd":
        for w in "abcd":
            assert sum(p[key(u, w, x)] for x in names) == pytest.approx(1)


def test_scores_of_many_blocks(spark, monkeypatch):
    """Blocks and parts of a few texts, words and contexts so common that parts share them."""
    monkeypatch.setattr(suffix_tree, "BLOCK", 300)
    monkeypatch.setattr(context_tables, "PART", 150)
    rng = random.Random(3)
    phrases = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(4)) for _ in range(12)]
    texts = {k: " ".join("of the" if rng.random() < 0.3 else rng.choice(phrases) if rng.random() < 0.7 else "the x" + str(rng.randint(0, 300)) for _ in range(rng.randint(0, 25))) for k in range(150)}
    texts |= {1000: "", 1001: " \t\n ", 1002: "A\x0bOF the\x0cof  the\rOf a\u2003b\x1cc \x85d"}
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    want, one, two = plain_tree([t for k, t in texts.items() if k not in held], texts.values())
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in suffix_tree.scored(frame).collect()}
    assert [got[k][0] for k in texts] == pytest.approx(want) and one > 20 and two > 10
    assert all(got[k][1] == len(t.encode().split()) + 1 for k, t in texts.items())


def test_scores_store_few_bytes_a_token(spark):
    """Tables written on the way are no rows of a token each: texts of words that hardly ever meet again."""
    rng = random.Random(5)
    texts = [(k, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(1000))) for k in range(100)]
    checkpoint_root(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))
    before = size()
    assert suffix_tree.scored(spark.createDataFrame(texts, "doc_id long, text string")).count() == 100
    assert size() - before < 18 * 100_000  # a row for every three words took 26


def test_packed_arrays_and_distinct_keys():
    rng = np.random.default_rng(2)
    arrays = [rng.integers(0, 2**k, 300).astype(np.uint64) for k in (1, 9, 33, 62)] + [np.empty(0, np.uint64), np.zeros(5, np.uint8), rng.random(7)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, context_tables.unpacked(context_tables.packed(*arrays)), strict=True))
    for keys in (rng.integers(0, 50, 400), rng.integers(0, 2**62, 400) // 2**53 * 2**53, np.empty(0, np.int64)):
        got, first, place = context_tables.distinct(keys)
        assert (got == np.unique(keys)).all() and (keys[first] == got).all() and (got[place] == keys).all()


# languages

def test_languages_held_out(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_word_backoff"](spark, sf).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_awkward(spark):
    rows = language_id.identified(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (3, 4, 5))
    assert language_id.identified(empty(spark)).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None), (2, "123 !", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identified(unlabelled).collect()} == {"und"}


def test_backoff_orders():
    places = {0: {"abc": 0}, 4: {"xyzw": 1}, 2: {"^q": 2}, 1: {"z": 3}}
    assert language_id.backoff("axyzwb", places) == ([1], 1.0)
    assert language_id.backoff("qr", places) == ([2], 0.25)
    assert language_id.backoff("zzr", places) == ([3, 3], 0.0625)
    assert language_id.backoff("k", places) == ([], 0.0)


# pipeline

def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_awkward(spark):
    for docs in (awkward(spark), empty(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, awkward(spark), "").collect()
