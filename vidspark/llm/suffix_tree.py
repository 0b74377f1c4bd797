"""Language-model scores from a probabilistic suffix tree.

The tree is over the words of a text (lower-cased, then a line feed as the end). A context is the one or
`ORDER` words before a token, whatever its share of the corpus, so the tree grows with the corpus. It is
retained if the next-word distribution diverges from that of its parent, the context without its oldest
word: the context was seen twice, and the gain in log likelihood exceeds half the log of the number of training
tokens for each different next word. Parents of
retained contexts stay. Each token is scored in the state of its longest retained suffix, whose distribution
is smoothed into the parent's in proportion to the number of different next words:
(n + kinds * p(parent)) / (total + kinds). The root is the unigram base: with c occurrences of a token among
N and a tokens seen once it gives c / (N + a), and a / (N + a) to all unseen ones.

The alphabet of `score` is that of `base_score`: the training tokens and one symbol for all others, whose
probability depends on the context; after any context all add up to 1. `spelled_score` tells unseen tokens
apart: it multiplies in the bytes of each under a byte tree of depth `DEPTH`.

Contexts, counts and probabilities are tables keyed by 64-bit hashes; they are joined and never collected.
Only the byte tree, a level of which holds at most 1 / `LEAST` contexts, goes to the tasks that spell words.

Defined results: null and empty texts are the end alone; a null id counts as '' when texts are held out;
repeated rows count and are scored each; with no training text every token is the one other symbol; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vidspark.llm.context_tables import BLOCK, Plan, answered, gathered, packed, steps, unpacked
from vidspark.llm.text import only
from vidspark.session import discarded, stored

DEPTH, LEAST = 4, 5e-5
ORDER = 2
#: Natural logs of the number of training tokens that a different next word of a context costs, and how often
#: a context must have been seen to be tested.
COST, SEEN = 0.5, 2
END = b"\n"
#: Before a word that is spelled on its own: no context that was seen in training goes on beyond the space.
ALONE = b"\0" * (DEPTH - 1) + b" "
#: Bytes of text counted at once, and different words or contexts a task holds before it hands on counts.
TOGETHER, HELD = 2_000_000, 400_000


def held_out(id_column: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def stream(words: list[bytes]) -> bytes:
    """Padding for the first context, the words, the end."""
    return END * DEPTH + b" ".join([*words, END])


def grams(data: bytes) -> np.ndarray:
    """Every context of DEPTH bytes with its next byte, oldest byte highest."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    out = b[: len(b) - DEPTH].copy()
    for d in range(1, DEPTH + 1):
        out = (out << 8) | b[d : len(b) - DEPTH + d]
    return out


def _merged(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed over equal codes."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(n, first)


def words_of(texts: pa.Array) -> pa.ListArray:
    """Words of every text, lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(words, "")  # beside white space at either end of a text
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][ends - ends[0]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(real))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words and of contexts with their next byte; texts held out count as 0. Where there is a
    column held_out, the texts follow as blocks (see `context_tables`) with lists of their other columns."""
    first = next(batches, None)
    if first is None:
        return
    others = {x: first.schema.field(x).type for x in first.schema.names if x != "_text"} if "held_out" in first.schema.names else {}
    kinds = {"word": pa.string(), "gram": pa.int64(), "n": pa.int64()}
    if others:
        kinds |= {"block": pa.int64(), "tokens": pa.binary(), "hashes": pa.binary(), **{x: pa.list_(k) for x, k in others.items()}}
    codes, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    texts: list[pa.ListArray] = []
    lists: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    size = tokens = long = made = 0

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        """Other columns are null."""
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(size, k) for x, k in kinds.items()], names=list(kinds))

    def block() -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([x.flatten() for x in texts]).dictionary_encode()
        end = len(coded.dictionary)
        lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in texts]).astype(np.uint32) + np.uint32(1)
        w = np.full(len(coded) + len(lengths), end, dtype=np.uint32)
        inside = np.ones(len(w), dtype=bool)
        inside[np.cumsum(lengths, dtype=np.int64) - 1] = False
        w[inside] = coded.indices.to_numpy()
        told = pa.Table.from_batches(lists).combine_chunks()
        told = {x: pa.concat_arrays(told.column(x).chunks) for x in others}
        out = told["held_out"].to_numpy(zero_copy_only=False) if others else np.zeros(len(lengths), dtype=bool)
        words = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
        yield rows(word=pa.array(words, pa.binary()).cast(pa.string()), n=pa.array(np.bincount(w[np.repeat(~out, lengths)], minlength=len(words))))
        if others:
            hashes = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
            order = np.argsort(hashes)
            place = np.empty(len(words), dtype=np.uint32)
            place[order] = np.arange(len(words))
            one = {"block": TaskContext.get().partitionId() << 33 | made, "tokens": packed(place[w], lengths, out.astype(np.uint8)), "hashes": packed(steps(hashes[order]))}
            ends = pa.array([0, len(lengths)], pa.int32())
            yield rows(**{x: pa.array([y], kinds[x]) for x, y in one.items()}, **{x: pa.ListArray.from_arrays(ends, told[x]) for x in others})

    for batch in itertools.chain([first], batches):
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(lengths, (lengths[low - 1] if low else 0) + TOGETHER, side="right")))
            some = batch.slice(low, high - low)
            texts.append(words_of(some.column("_text")))
            lists.append(some.select(list(others)))
            tokens += len(texts[-1].flatten()) + len(texts[-1])
            held = some.column("held_out").to_pylist() if others else [False] * some.num_rows
            for x, out in zip(pc.binary_join(texts[-1], " "), held, strict=True):
                if not out:
                    parts.append(grams(b"".join((END * DEPTH, x.as_buffer(), b" " if len(x.as_buffer()) else b"", END))))
                    size += len(parts[-1])
            if size >= TOGETHER:
                new, times = np.unique(np.concatenate(parts), return_counts=True)
                codes, n = _merged(np.concatenate((codes, new)), np.concatenate((n, times)))
                parts, size = [], 0
            long += int(lengths[high - 1] - (lengths[low - 1] if low else 0))
            if tokens >= BLOCK or long >= 12 * BLOCK:
                yield from block()
                texts, lists, tokens, long, made = [], [], 0, 0, made + 1
            if len(codes) >= HELD:
                yield rows(gram=pa.array(codes), n=pa.array(n))
                codes, n = codes[:0], n[:0]
            low = high
    if texts:
        yield from block()
    new, times = np.unique(np.concatenate([*parts, codes[:0]]), return_counts=True)
    if new.size or codes.size:
        codes, n = _merged(np.concatenate((codes, new)), np.concatenate((n, times)))
        yield rows(gram=pa.array(codes), n=pa.array(n))
    pa.default_memory_pool().release_unused()  # the worker lives on


def counted(texts: DataFrame) -> DataFrame:
    """The rows of `_count`, stored. Where there is a column held_out, with the blocks."""
    kinds = [f"{f.name} array<{f.dataType.simpleString()}>" for f in texts.schema.fields if f.name != "_text"]
    blocks = ["block long", "tokens binary", "hashes binary", *kinds] if "held_out" in texts.columns else []
    return stored(texts.mapInArrow(_count, ", ".join(["word string, gram long, n long", *blocks])), tidy=True)


def tree_counts(counted: DataFrame, least: float) -> list[tuple[int, int, int, int]]:
    """(depth, context, next byte, count) of retained contexts; at most 1 / least contexts per depth."""
    full = counted.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    total = full.agg(F.sum("n")).first()[0]
    if not total:
        return []
    levels = None
    for depth in range(DEPTH + 1):
        context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))
        level = full.groupBy(F.lit(depth).alias("depth"), context.alias("context"), F.col("gram").bitwiseAND(F.lit(255)).alias("next")).agg(F.sum("n").alias("n"))
        levels = level if levels is None else levels.unionByName(level)
    levels = stored(levels, tidy=True)
    sums = levels.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter(F.col("total") >= F.lit(least * total))
    big = levels.join(sums, ["depth", "context"])
    parent = big.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("parent"), "next", F.col("n").alias("pn"), F.col("total").alias("ptotal"))
    own = big.withColumn("parent", F.when(F.col("depth") > 0, F.col("context").bitwiseAND(F.expr("shiftleft(1L, cast(8 * (depth - 1) as int)) - 1"))))
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("pn") / F.col("ptotal"))))
    tested = own.join(parent, ["depth", "parent", "next"]).groupBy("depth", "context").agg(gain.alias("gain"), F.max("total").alias("total"), F.max("kinds").alias("kinds"))
    passed = tested.filter(F.col("gain") > 0.5 * F.col("kinds") * F.log("total")).select("depth", "context")
    kept = {(r["depth"], r["context"]) for r in passed.collect()} | {(0, 0)}
    for depth, context in list(kept):
        kept |= {(d, context & ((1 << 8 * d) - 1)) for d in range(depth)}
    rows = big.select("depth", "context", "next", "n").collect()
    return [tuple(r) for r in rows if (r["depth"], r["context"]) in kept]


def build(rows: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(child by node and older byte, or 0; log10 probability by node and next byte). Node 0 is the root."""
    nodes = {key: k for k, key in enumerate(sorted({(0, 0)} | {(d, c) for d, c, _, _ in rows}))}
    counts = np.zeros((len(nodes), 256))
    for d, c, nxt, n in rows:
        counts[nodes[d, c], nxt] = n
    child, p = np.zeros((len(nodes), 256), dtype=np.int32), np.empty((len(nodes), 256))
    for (d, c), k in nodes.items():  # parents first
        if not d:
            p[k] = (counts[k] + 1) / (counts[k].sum() + 256)
            continue
        up = nodes[d - 1, c & ((1 << 8 * (d - 1)) - 1)]
        child[up, c >> 8 * (d - 1)] = k
        kinds = np.count_nonzero(counts[k])
        p[k] = (counts[k] + kinds * p[up]) / (counts[k].sum() + kinds)
    return child, np.log10(p).astype(np.float32)


def byte_logs(data: bytes, child: np.ndarray, logs: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """log10 probabilities of all bytes behind the padding, each in the state of its longest suffix."""
    b = np.frombuffer(data, dtype=np.uint8)
    flat, table, out = child.ravel(), logs.ravel(), np.empty(len(b) - DEPTH, dtype=np.float64)
    for low in range(DEPTH, len(b), block):
        high = min(len(b), low + block)
        state = flat[b[low - 1 : high - 1]].astype(np.int64)
        walking = state > 0
        for d in range(2, DEPTH + 1):
            deeper = flat[state * 256 + b[low - d : high - d]]
            walking &= deeper > 0
            state = np.where(walking, deeper, state)
        out[low - DEPTH : high - DEPTH] = table[state * 256 + b[low:high]]
    return out


def _spell(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """hash, count and, of the unseen, natural log of the spelling of every word."""
    child, logs = model.value
    for batch in batches:
        every = [x.encode() for x in batch.column("word").to_pylist()]
        unseen = np.flatnonzero(batch.column("c").to_numpy() == 0)
        words = [every[k] for k in unseen]
        spelled, low = np.empty(len(words)), 0
        while low < len(words):
            high, size = low, 0
            while high < len(words) and size < TOGETHER:
                size += len(words[high]) + 1 + DEPTH
                high += 1
            data = b"".join(ALONE + (x if x == END else x + b" ") for x in words[low:high])
            sizes = np.fromiter((len(x) + (x != END) for x in words[low:high]), dtype=np.int64, count=high - low)
            starts = np.r_[0, np.cumsum(sizes + DEPTH)[:-1]]
            each = np.r_[np.zeros(DEPTH), byte_logs(data, child, logs)]
            each[(starts[:, None] + np.arange(DEPTH)).ravel()] = 0  # the padding
            spelled[low:high] = np.add.reduceat(each, starts)
            low = high
        hashes = np.fromiter(map(xxh64_intdigest, every), dtype=np.uint64, count=len(every)).view(np.int64)
        logs10 = np.zeros(len(every))
        logs10[unseen] = spelled
        yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column("c"), pa.array(logs10 * math.log(10))], names=["w", "c", "spelled"])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(h: np.ndarray) -> np.ndarray:
    """One key per token with its ORDER words before it."""
    return _mixed(_mixed(h[:-2], h[1:-1]), h[2:])


def _rows(batches: Iterator[pa.RecordBatch], plan: Plan, hot: tuple) -> Iterator[pa.RecordBatch]:
    """t, c, spelled, p of every different token with its context of a block."""
    for block, own in gathered(batches, plan, hot):
        h = np.r_[np.uint64(0), np.cumsum(unpacked(own["hashes"])[0], dtype=np.uint64)[block.sorted]]
        t, at = np.unique(_mixed(_mixed(h[block.before(block.v)], h[block.v]), h[block.w]), return_index=True)
        w = block.w[at]
        yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(block.count[w].astype(np.int64)), pa.array(block.spelled[w]), pa.array(block.logs()[at])], names=["t", "c", "spelled", "p"])


def _sums(batches: Iterator[pa.RecordBatch], plan: Plan, hot: tuple) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, n_tokens, n_known, _base, score, _spelled of every text."""
    for block, own in gathered(batches, plan, hot):
        c, each = block.count[block.w], lambda x, start=block.start: np.add.reduceat(x, start)
        ln = math.log(10)
        yield pa.RecordBatch.from_arrays(
            [own["doc_id"], own["held_out"], pa.array(block.lengths.astype(np.int64)), pa.array(each((c > 0).astype(np.int64))), pa.array(each(np.log10(c + 1))), pa.array(each(block.logs()) / ln), pa.array(each(block.spelled[block.w]) / ln)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "_base", "score", "_spelled"],
        )


def model_of(texts: DataFrame, *, least: float = LEAST) -> tuple[DataFrame, tuple, int, int]:
    """(word counts, (child, logs, tokens seen once), tokens, different tokens).
    Where `texts` has a column held_out, such texts only add their words to the table, with a count of 0."""
    return _model(counted(texts), least)


def _model(counts: DataFrame, least: float) -> tuple[DataFrame, tuple, int, int]:
    words = stored(counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")), tidy=True)
    n, v, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count(F.when(F.col("c") == 1, 1))).first()
    return words, (*build(tree_counts(counts, least)), max(once, 1)), n, v


def _blocks(counts: DataFrame) -> DataFrame:
    return counts.filter("block is not null").drop("word", "gram", "n")


def probabilities(rows: DataFrame, words: DataFrame, *, n: int, once: int, order: int = ORDER) -> DataFrame:
    """t, c (count of the token), p (its natural log probability in the state of its longest retained suffix)
    and, where it is unseen, the log of its spelling, of every different token with context in `rows`
    (_text, held_out). `words`: w, c, spelled."""
    blocks, plan, hot = answered(_blocks(counted(rows)), words, n=n, once=once, order=order, cost=COST, seen=SEEN)
    every = blocks.mapInArrow(partial(_rows, plan=plan, hot=hot), "t long, c long, spelled double, p double")
    return every.groupBy("t").agg(*[F.max(x).alias(x) for x in ("c", "spelled", "p")])


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, least: float = LEAST, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score of every row. With `order` 1 or 0
    the tree ends at contexts of one word, or at its root."""
    spark: SparkSession = docs.sparkSession
    rows = only(docs, doc_id=id_col, _text=text_col).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    counts = counted(rows)
    words, (child, logs, once), n, v = _model(counts, least)
    spelled = stored(words.mapInArrow(partial(_spell, model=spark.sparkContext.broadcast((child, logs))), "w long, c long, spelled double"))
    texts = stored(_blocks(counts))
    for x in (counts, words):
        discarded(x)
    blocks, plan, hot = answered(texts, spelled, n=n, once=once, order=order, cost=COST, seen=SEEN)
    discarded(spelled)
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, _base double, score double, _spelled double"
    known = blocks.mapInArrow(partial(_sums, plan=plan, hot=hot), kind)
    return known.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), "score", (F.col("score") + F.col("_spelled")).alias("spelled_score"),
    )
