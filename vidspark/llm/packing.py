"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokens: a tokenizer's ids, then an end id. Words (split at ASCII white space, which the tokenizer drops)
are told apart in Arrow, some texts together; each different one is looked up or encoded once, and the ids of the texts
are gathered from those of their words. Encoded words are remembered, within a bound. Documents
longer than a sequence are cut into full pieces and a rest.

Packing works on lengths alone: Spark counts the pieces per length (at most `capacity` counts, whatever
the size of the corpus), bin completion turns the counts into fillings, and each piece finds its place
by its number among the pieces of its length, through a table of fillings with a bounded number of rows.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; null ids stay
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.llm.bin_completion import pack
from vidspark.llm.text import only
from vidspark.session import stored

CAPACITY, END = 4096, 1
#: Words of late that a worker remembers (and as many from before), bytes of text it looks at together, and words it encodes together.
REMEMBERED, TOGETHER, ENCODED = 100_000, 2_000_000, 2_000
#: Letters that lowering and normalising leave as they are, then ASCII marks but the apostrophe.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The characters by which byte-level vocabularies spell the bytes of UTF-8.
BYTES = dict(zip([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100), *range(0x21), *range(0x7F, 0xA1), 0xAD], map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100), *range(0x100, 0x144)]), strict=True))


class WordEncoder:
    """Little-endian 32-bit ids of texts, word by word, from a tokenizers file.

    Holds for tokenizers that lower ASCII capitals, split at ASCII white space and drop it, and part
    letters from punctuation, as word_bpe_49k.json does. New words are encoded together, as one text. Of a
    byte-level vocabulary, words of plain letters with marks behind them are put together from
    these two parts, and their letters go straight to the model."""

    ready: dict[str, WordEncoder] = {}  # by file: a worker keeps what it knows from task to task

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # words met of late, and those met before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        probe = ["straße", "don", "naïvement", "xÿz"]
        self.learn(probe)
        self.direct = all(self.letters(w) == self.known[w] for w in probe)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls.ready:
            cls.ready[path] = cls(path)
        return cls.ready[path]

    def letters(self, word: str) -> bytes:
        """Ids of a word of plain letters, of which no step before the model changes more than the spelling of its bytes."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def learn(self, words: list[str]) -> None:
        """Ids of a token belong to the word in which the token starts."""
        for low in range(0, len(words), ENCODED):
            part = words[low : low + ENCODED]
            done = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(t) + 1 for t in part])
            offsets = np.array(done.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            at = (np.searchsorted(offsets, starts) * 4).tolist()
            ids = np.array(done.ids, dtype="<u4").tobytes()
            self.known.update(zip(part, (ids[x:y] for x, y in zip(at, at[1:], strict=False)), strict=True))

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of different lowered words."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        if len(self.marks) > REMEMBERED:
            self.marks = {}
        known, older, marks, rest = self.known, self.older, self.marks, []
        out = list(map(known.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        for k in missing:
            w = words[k]
            ids = older.get(w)
            if ids is None:
                plain = PLAIN.fullmatch(w) if self.direct else None
                if plain is None:
                    rest.append(k)
                    continue
                stem, mark = plain.groups()
                ids = known.get(stem) or older.get(stem) or self.letters(stem)
                if mark:
                    if mark not in marks:
                        marks[mark] = array("I", self.tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
                    ids += marks[mark]
            known[w] = out[k] = ids
        self.learn([words[k] for k in rest])
        for k in rest:
            out[k] = known[words[k]]
        return out

    def encode(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        told = split.flatten().dictionary_encode()
        each = self.of_words(told.dictionary.to_numpy(zero_copy_only=False).tolist())
        own, at = np.frombuffer(b"".join(each), dtype="<u4"), told.indices.to_numpy()
        sizes = np.array(list(map(len, each)), dtype=np.int64) // 4
        lengths = sizes[at]
        ends = np.r_[0, np.cumsum(lengths)]
        ids = own[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        bounds = (ends[split.offsets.to_numpy()] * 4).tolist()
        return [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, last, step = WordEncoder.of(path), np.array([end], dtype="<u4").tobytes(), 4 * capacity
    for batch in batches:
        ids = batch.column("doc_id")
        texts = batch.column("_text").fill_null("")
        sizes = pc.binary_length(texts).to_pylist()
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + sizes[high] <= TOGETHER):
                size += sizes[high]
                high += 1
            row, piece, start, length, crc, blobs = [], [], [], [], [], []
            for k, data in enumerate(encoder.encode(texts.slice(low, high - low))):
                data += last
                for p, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    row.append(low + k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        blobs.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(blobs, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            low = high


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""
    rows = only(docs, doc_id=id_col, _text=text_col)
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(partial(_cut, path=tokenizer, capacity=capacity, end=end, with_ids=with_ids), kind)


def places(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, beyond, per sequence, first sequence, offset): pieces of a length numbered from
    `first` to `beyond` go, so many per sequence, to sequences from `first sequence` on."""
    used: dict[int, int] = {}
    out, base = [], 0
    for items, times in pack(lengths, capacity):
        offset = 0
        for x in sorted(set(items), reverse=True):
            each = items.count(x)
            first = used.get(x, 0)
            out.append((x, first, first + each * times, each, base, offset))
            used[x] = first + each * times
            offset += each * x
        base += times
    return out


def assigned(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (pieces with `length`) with sequence_id and offset. Pieces are numbered per length and
    partition, after both are written down (the ids take less room in Parquet than in a checkpoint), so no length is gathered in one task."""
    spark = cut.sparkSession
    laid = stored(cut.withColumn("_pid", F.spark_partition_id()))
    counts = laid.groupBy("_pid", "length").agg(F.count(F.lit(1)).alias("_c"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_c").alias("n")).collect()}  # at most `capacity` rows
    names = ["length", "_first", "_beyond", "_each", "_base", "_offset"]
    laid_out = np.array(places(histogram, capacity), dtype=np.int64).reshape(-1, len(names))
    # an Arrow table goes to the JVM as it is; rows would start Python workers of their own beside the encoders
    table = spark.createDataFrame(pa.table({c: laid_out[:, k] for k, c in enumerate(names)}))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("length").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = laid.withColumn("_in", F.row_number().over(W.partitionBy("_pid", "length").orderBy("doc_id", "piece")) - 1)
    numbered = numbered.join(counts.select("_pid", "length", before.alias("_before")), ["_pid", "length"]).withColumn("_k", F.col("_in") + F.col("_before"))
    # a few rows per length: bounded by the capacity, not by the data
    found = numbered.join(F.broadcast(table), (numbered["length"] == table["length"]) & (F.col("_k") >= F.col("_first")) & (F.col("_k") < F.col("_beyond"))).drop(table["length"])
    nth = F.col("_k") - F.col("_first")
    return found.select(
        *[c for c in cut.columns],
        (F.col("_base") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, **options) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return assigned(pieces(docs, tokenizer, capacity=capacity, end=end, **options), capacity=capacity)
