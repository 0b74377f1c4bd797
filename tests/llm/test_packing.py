import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import AWKWARD, awkward, empty
from vidspark.llm import packing
from vidspark.llm.bin_completion import best_fit, pack
from vidspark.llm.queries import QUERIES, word_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_tokenizer())


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, tokenizer, capacity=4096):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = plain_ids(tokenizer, texts[d])
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // capacity)))
        for r in parts:
            own = np.array(ids[r["start"] : r["start"] + capacity], dtype="<u4")
            assert (r["start"], r["length"], r["ids_crc32"]) == (r["piece"] * capacity, len(own), zlib.crc32(own.tobytes()))
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts[:-1]]))
        assert sum(r["length"] for r in parts) <= capacity
    return len(by_sequence)


def test_query_against_whole_encoding(spark, sf, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_bin_completion"](spark, sf).collect()
    used = check(rows, texts, tokenizer)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 1


ODD = ["It's DON'T we'll", "a.b, c... x., é. É́ é. 3.14, v2. <|endoftext|> <|endoftext|>. x<|startoftext|>y", "  　 a b", "ΟΔΥΣΣΕΥΣ. İstanbul K", "𝒳𝒳, ✓✓. ́x", "a,b. .. ,, ., x.y. l'été. it's."]


def test_word_by_word_is_the_whole(tokenizer):
    encoder = packing.WordEncoder(word_tokenizer())
    for text in [*ODD, " ".join(ODD)]:
        assert np.frombuffer(encoder.encode([text.encode()])[0], dtype="<u4").tolist() == plain_ids(tokenizer, text)[:-1], text


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder = packing.WordEncoder(word_tokenizer())
    for text in [*ODD, "one two. one, two three. four"] * 2:
        assert np.frombuffer(encoder.encode([text.encode()])[0], dtype="<u4").tolist() == plain_ids(tokenizer, text)[:-1]


MARKED = "straße, naïve!? œuf. don't. 'tis rock'n'roll's \"quoted\" (x) a-b 3rd é, é. Ça ÀÉ ÿ~ x<|endoftext|> y<| |> ªº. µm ×÷ a\u00ada ﬁn. x\u0338= y=\u0338 __z__ end--"


def test_marked_words_are_the_whole(tokenizer):
    letters = [chr(c) for c in range(0x21, 0x180)]
    rng = random.Random(5)
    texts = [MARKED, *(" ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(200)) for _ in range(20)), " \t\n", "", "\x0b a  b\f"]
    encoder = packing.WordEncoder(word_tokenizer())
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain_ids(tokenizer, text)[:-1], text


def test_plain_words_are_not_encoded_as_texts(monkeypatch):
    encoder, asked = packing.WordEncoder(word_tokenizer()), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (asked.extend(words), learn(words)))
    encoder.encode([b"Every plain word, with (or without marks) *** but not it's", "et l'été déjà passé!".encode()])
    assert sorted(asked) == ["(or", "***", "it's", "l'été"]


def test_words_in_use_stay_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    encoder, asked = packing.WordEncoder(word_tokenizer()), []
    monkeypatch.setattr(encoder, "letters", lambda word, f=encoder.letters: (asked.append(word), f(word))[1])
    for k in range(100):
        encoder.encode([b"often " + b" ".join(b"w" * (k + 1) + bytes([97 + j]) * (j + 1) for j in range(20))])
        assert len(encoder.known) + len(encoder.older) <= 2 * (50 + 21)
    assert asked.count("often") == 1


def test_places_start_no_python_workers(spark, capsys):
    cut = spark.createDataFrame([(k, 0, 0, k % 7 + 1, k) for k in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.assigned(cut, capacity=8)
    out.explain()
    assert "ExistingRDD" not in capsys.readouterr().out
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(50))


def test_awkward_rows(spark, tokenizer):
    rows = packing.packed(awkward(spark), word_tokenizer(), capacity=64).collect()
    want = Counter()
    for d, text, *_ in AWKWARD:
        n = len(plain_ids(tokenizer, text))
        want.update((d, p, min(64, n - 64 * p)) for p in range(-(-n // 64)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in rows) == want
    assert packing.packed(empty(spark), word_tokenizer()).collect() == []
    ids = packing.pieces(awkward(spark), word_tokenizer(), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in ids)


def placed(counts, capacity, fillings):
    got = Counter()
    for items, n in fillings:
        assert n > 0 and sum(items) <= capacity
        for x in items:
            got[x] += n
    assert got == Counter(counts)
    return sum(n for _, n in fillings)


def fewest(items, capacity):
    """Exact, by trying all places."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= items[k]:
                rest = list(rooms)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_small_cases_are_optimal(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 30])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
    counts = dict(Counter(items))
    assert placed(counts, capacity, pack(counts, capacity, most=50, steps=5000)) == fewest(items, capacity)


def test_large_histograms():
    rng = np.random.default_rng(2)
    counts = dict(Counter((np.clip(rng.lognormal(6.5, 1.0, 20_000), 1, 4096).astype(int)).tolist()))
    bound = -(-sum(x * n for x, n in counts.items()) // 4096)
    found = placed(counts, 4096, pack(counts, 4096))
    assert bound <= found <= placed(counts, 4096, best_fit(counts, 4096)) and found <= bound + 3
    assert pack({}, 10) == [] and pack({10: 7}, 10) == [((10,), 7)]
    assert placed({6: 10**12, 4: 10**12}, 10, pack({6: 10**12, 4: 10**12}, 10)) == 10**12
