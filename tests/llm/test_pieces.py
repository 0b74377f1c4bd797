"""Encoding through the table of last tokens: the library, merging alone, awkward rows."""

import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from tests.llm.cases import AWKWARD, awkward, empty
from vidspark.llm import sentence_pieces
from vidspark.llm.prefix_table import PrefixTable
from vidspark.llm.queries import QUERIES, piece_model


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def prefixes():
    return PrefixTable.of(piece_model())


BITS = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "1", "2023", "é", "ß", "中", "文", "𝒳", "▁", ".", ",", "ing", "the", "\x00", "<s>", "</s>", "<unk>", "<0x41>", " ", "ﬁ", "한", " " * 25, "www", "--", "=="]


def test_like_the_library(library, prefixes):
    rng = random.Random(5)
    texts = ["", " ", "▁", *("".join(rng.choice(BITS) for _ in range(rng.randint(1, 70))) for _ in range(1500))]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x80, 0x2FF), rng.randint(0x400, 0x4FF), rng.randint(0x3040, 0x9FFF)])) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    for text in texts:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = np.frombuffer(prefixes.encode(text), dtype="<u4")
        assert got.tolist() == want and prefixes.decode(got) == library.decode(want), text


def test_borders_against_merging(prefixes):
    rng = random.Random(9)
    pieces = [p for p in rng.sample(sorted(prefixes.score), 6000) if prefixes.stable(p)]
    for left, right in zip(pieces, rng.sample(pieces, len(pieces)), strict=True):
        for x, y in ((left, right), (left, right.lstrip("▁") or right)):
            if prefixes.merged(y) == [y]:
                assert prefixes.kept_apart(x, y) == (prefixes.merged(x + y) == [x, y]), (x, y)


def test_any_ids(library, prefixes):
    rng = random.Random(11)
    for _ in range(1500):
        ids = [rng.choice([rng.randint(0, 260), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 12))]
        assert prefixes.decode(np.array(ids, dtype=np.int64)) == library.decode(ids), ids


def test_long_stretches(library, prefixes):
    for text in ("x9Kq" * 20000, "ab" * 20000, " " * 30000, "wort" * 9000 + "\n" + "é" * 9000):
        assert np.frombuffer(prefixes.encode(text), dtype="<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_bounded_memory(library, monkeypatch):
    import vidspark.llm.prefix_table as module

    monkeypatch.setattr(module, "REMEMBERED", 3)
    monkeypatch.setattr(module, "PAIRS", 5)
    small = PrefixTable(piece_model())
    for text in ("one two three four", "five six seven one", "one two three four"):
        assert np.frombuffer(small.encode(text, end=False), dtype="<u4").tolist() == library.encode(text, add_bos=True)


@pytest.mark.parametrize("extra", [True, False])
def test_awkward(spark, library, extra):
    coded = sentence_pieces.encoded(awkward(spark, extra), piece_model(), with_text=True)
    got = sorted((r["doc_id"] or 0, r["ids"], r["text"]) for r in coded.collect())
    want = [library.encode(r[1] or "", add_bos=True, add_eos=True) for r in AWKWARD]
    assert got == sorted((r[0] or 0, ids, library.decode(ids)) for r, ids in zip(AWKWARD, want, strict=True))
    back = sentence_pieces.decoded(coded, piece_model()).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((k, t) for k, _, t in got)
    assert sentence_pieces.encoded(empty(spark), piece_model()).collect() == []
    assert sentence_pieces.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), piece_model()).first()["text"] == ""


def test_query(spark, sf, library):
    import hashlib

    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_prefix_table"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert got.pop(r["doc_id"]) == (len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(library.decode(ids).encode()))
    assert got == {}
