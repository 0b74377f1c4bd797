"""Near-duplicates by SimHash fingerprints and BK-trees of shards.

Equal fingerprints are folded first. Distinct ones are put into shards so that every pair that can be
linked shares one, and a BK-tree per shard finds the pairs within the radius. A tree is shipped to the
task that asks it (shards travel by key); it is never broadcast to all, since the trees together grow
with the data. Each shard returns a spanning forest of its links, never the pairs; the forests are
joined to components in Spark.

Shards, `shards="blocks"` (exact for any radius): the 64 bits are cut into radius + 2 blocks, at most
`radius` of which can differ, so a linked pair agrees in some two blocks: one shard per pair of blocks
and their value. A shard above `SHARD` is cut again by two blocks of its free bits, which leaves at most
65,536 values at radius 2. `shards="sketch"` (for wider radii): one shard per two min-hashes of the word
shingles, `SKETCHES` in all. A shard above the limit is cut, without losing a pair, by the bits: they are dealt
into radius + 1 blocks, one of which any two values within the radius agree in; each block is searched whole. So
the links do not depend on the limit. Here each shard returns its nearest links (`bk_forest`).

`first_of_groups` takes such links, at a radius wide enough for the scatter of the fingerprints, as candidates: the
two texts of each are compared, and only those whose sets of shingles have a Jaccard similarity of at least `least` link.
What the fingerprints miss is found by prefixes: in one order of all shingles, two sets of n and m shingles that are so
similar share one of the first n - ceil(least * n) + 1 and m - ceil(least * m) + 1. All pairs that share such a key and lie in
different groups are compared, so no link is lost. The order (shingles frequent in a sample last) only saves work.
Every text has parity bits: bit h is set if an odd number of its shingles fall on it. Two texts differ in no more bits
than in shingles, so a pair that differs in more than the threshold allows is left out unseen, where a key is crowded.

Defined results: null or empty texts have fingerprint 0 and are linked like any other; null ids rank
last (component_id is null only if all ids of the component are); repeated rows are kept and share a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.llm import bk_forest, bk_tree
from vidspark.llm.text import only
from vidspark.operators.graph import connected_groups
from vidspark.session import cut_lineage, stored

SEED, SHARD, SKETCHES = 42, 65_536, 5
#: A key of more texts is crowded: its pairs are sifted by parity bits, of which a text has a power of two, at least
#: SHARP for each shingle, within these bounds.
CROWD, SHARP, LEAST_BITS, MOST_BITS = 16, 2, 512, 16_384
#: Bitmaps of 32,768 places in which asked texts are marked: a bound, beyond which more texts than asked are dealt out.
MARKS = 256
#: Shingles a task keeps of the texts it compared last.
REMEMBERED = 2_000_000
#: Texts whose shingles are counted for the order of the keys, how often one must be met there to come late, and the
#: most that do; pairs of texts a task hands on at once.
SAMPLE, FREQUENT, LATE, PAIRS = 20_000, 8, 50_000, 1_000_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included; ASCII capitals lowered, ASCII white space."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) <= words:
        return np.array([xxh64_intdigest(b" ".join(w), SEED)], dtype=np.uint64)
    parts = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False))
    return np.fromiter((xxh64_intdigest(x, SEED) for x in parts), dtype=np.uint64, count=len(w) - words + 1)


def fingerprint(hashes: np.ndarray, block: int = 65_536) -> int:
    """Bit i is set if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[low : low + block])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def parities(hashes: np.ndarray) -> bytes:
    """Parity bits of a set of shingles; halves of the bits laid over each other are those of half the width."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (SHARP * len(hashes) - 1).bit_length())) if len(hashes) else LEAST_BITS
    return np.packbits(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def _prints(batches: Iterator[pa.RecordBatch], words: int, sketches: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints and, per sketch, a hash of two min-hashes: of pairs with a Jaccard similarity of 0.8, 0.64
    agree in one sketch and 99.4 % in one of five; of texts that share a fifth of their shingles, few do.
    With sketches also the parity bits."""
    from xxhash import xxh64_intdigest

    factors = np.array([xxh64_intdigest(bytes([k]), SEED) | 1 for k in range(2 * sketches)], dtype=np.uint64)
    for batch in batches:
        prints, mins, bits = np.empty(batch.num_rows, dtype=np.uint64), [], []
        for k, value in enumerate(batch.column("_text")):
            hashes = shingle_hashes((value.as_py() or "").encode(), words)
            prints[k] = fingerprint(hashes) if len(hashes) else 0
            if sketches:
                mixed = hashes ^ (hashes >> np.uint64(29))
                low = np.array([(mixed * f).min() for f in factors] if len(hashes) else [0] * 2 * sketches, dtype=np.uint64)
                mins.append((low[::2] * factors[0] ^ low[1::2]).view(np.int64).tolist())
                bits.append(parities(np.unique(hashes)))
        columns = [batch.column(c) for c in batch.schema.names if c != "_text"] + [pa.array(prints.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(mins, pa.list_(pa.int64())), pa.array(bits, pa.binary())] if sketches else []), names=[*(c for c in batch.schema.names if c != "_text"), "fp", *(["mins", "bits"] if sketches else [])])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, sketches: int = 0) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed long) and, if asked for, min-hashes and parity bits."""
    rows = only(docs, doc_id=id_col, _text=text_col).select("doc_id", F.xxhash64("_text").alias("text_hash"), "_text")
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long" + ", mins array<long>, bits binary" * bool(sketches)
    return rows.mapInArrow(partial(_prints, words=words, sketches=sketches), kind)


def _cuts(free: tuple[int, ...], radius: int) -> list[tuple[int, ...]]:
    """Sets of bits, one of which two values agree in if at most `radius` of the free bits differ."""
    blocks = [tuple(int(x) for x in b) for b in np.array_split(np.array(free), radius + 2)]
    return [a + b for a, b in combinations(blocks, 2) if a or b]


def _signed(bits: tuple[int, ...]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _block_keys(radius: int) -> tuple[Column, Column]:
    """First and second level: arrays of (kind, value); the second depends on the kind of the first."""
    first = _cuts(tuple(range(64)), radius)
    take = lambda bits: F.col("fp").bitwiseAND(F.lit(_signed(bits)).cast("long"))
    top = F.array(*[F.struct(F.lit(k).alias("kind"), take(bits).alias("value")) for k, bits in enumerate(first)])
    deep = None
    for k, bits in enumerate(first):
        free = tuple(b for b in range(64) if b not in bits)
        sub = F.array(*[F.struct(F.lit(1000 * (k + 1) + j).alias("kind"), take(bits + more).alias("value")) for j, more in enumerate(_cuts(free, radius))])
        deep = F.when(F.col("kind") == k, sub) if deep is None else deep.when(F.col("kind") == k, sub)
    return top, deep


def _sketch_keys(radius: int) -> list[Column]:
    """A level of sketches and one of blocks of bits inside a shard of it."""
    blocks = [tuple(int(x) for x in b) for b in np.array_split(np.arange(64), radius + 1)]
    take = lambda bits: F.xxhash64("kind", "value", F.col("fp").bitwiseAND(F.lit(_signed(bits)).cast("long")))
    top = F.array(*[F.struct(F.lit(k).alias("kind"), F.xxhash64(F.lit(k), F.get("mins", F.lit(k))).alias("value")) for k in range(SKETCHES)])
    cut = F.array(*[F.struct(F.lit(1000 + k).alias("kind"), take(bits).alias("value")) for k, bits in enumerate(blocks)])
    return [top, cut]


def _forest(batches: Iterator[pa.RecordBatch], radius: int, rows: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Sorted (kind, value, fp): for every shard (fp, lowest fp of its group) or, if `nearest`, the links of a minimum
    spanning forest. Whole shards are worked on together up to `rows` entries, so small shards cost no call of their own."""
    held: list[pa.RecordBatch] = []
    count = 0

    def work(table: pa.Table):
        kind, value, fp = (table.column(c).to_numpy() for c in ("kind", "value", "fp"))
        shard = np.r_[0, np.cumsum((kind[1:] != kind[:-1]) | (value[1:] != value[:-1]))]
        if nearest:
            a, b = bk_forest.forest(shard, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])
        low = bk_tree.linked(shard, fp.view(np.uint64), radius)
        tied = np.flatnonzero(low != np.arange(len(low)))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[low[tied]])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            kind, value = table.column("kind").to_numpy(), table.column("value").to_numpy()
            inner = np.flatnonzero((kind[1:] != kind[:-1]) | (value[1:] != value[:-1]))
            if inner.size:  # up to the last shard, which may go on in the next batch
                cut = int(inner[-1]) + 1
                yield work(table.slice(0, cut))
                held, count = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if count:
        yield work(pa.Table.from_batches(held))


def _links(keyed: DataFrame, radius: int, nearest: bool) -> DataFrame:
    spark = keyed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    laid = keyed.select("kind", "value", "fp").repartition(parts, "kind", "value").sortWithinPartitions("kind", "value", "fp")
    return laid.mapInArrow(partial(_forest, radius=radius, rows=32_768, nearest=nearest), "a long, b long")


def print_links(prints: DataFrame, *, radius: int, shards: str = "blocks", limit: int = SHARD) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that lie within `radius` of each other
    and share a shard. `prints`: fp, with shards="sketch" also mins; best read from a cut lineage."""
    if shards == "blocks":
        top, deep = _block_keys(radius)
        levels = [top, deep]
        base, repeated = prints.select("fp").distinct(), False
    else:
        levels, repeated = _sketch_keys(radius), True
        base = prints.select("fp", "mins").distinct()
    rows, out = base, []
    for depth, keys in enumerate(levels):
        keyed = rows.select("fp", F.explode(keys).alias("_k")).select("fp", "_k.kind", "_k.value")
        if depth or repeated:
            keyed = keyed.distinct()
        counts = keyed.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        last = depth == len(levels) - 1
        some = keyed.join(counts if last else counts.filter(F.col("n") <= limit), ["kind", "value"])
        out.append(_links(some, radius, repeated))
        if last or counts.filter(F.col("n") > limit).isEmpty():
            break
        rows = keyed.join(counts.filter(F.col("n") > limit), ["kind", "value"]).drop("n")
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links.distinct()


def components(prints: DataFrame, *, radius: int, shards: str = "blocks", limit: int = SHARD) -> DataFrame:
    """fp and `low`, the lowest (id unknown, id, text hash) of its component."""
    links = cut_lineage(print_links(prints, radius=radius, shards=shards, limit=limit))
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    each = prints.groupBy("fp").agg(F.min(rank).alias("low"))
    if links.isEmpty():
        return each
    roots = connected_groups(links, a="a", b="b").withColumnRenamed("id", "fp")
    member = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = member.groupBy("root").agg(F.min("low").alias("lowest"))
    return member.join(lowest, "root").select("fp", F.col("lowest").alias("low"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, shards: str = "blocks", limit: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = cut_lineage(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, sketches=SKETCHES if shards == "sketch" else 0))
    groups = components(prints, radius=radius, shards=shards, limit=limit)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low.doc_id").alias("component_id"))


def _alike(batches: Iterator[pa.RecordBatch], words: int, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts have sets of shingles with a Jaccard similarity of at least `least`."""
    known: dict[int, np.ndarray] = {}
    size = 0

    def shingles(key: int, text: str | None) -> np.ndarray:
        nonlocal size
        if key not in known:
            if size > REMEMBERED:
                known.clear()
                size = 0
            known[key] = np.unique(shingle_hashes((text or "").encode(), words))
            size += len(known[key])
        return known[key]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        stay = []
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            one, two = shingles(x, batch.column("a_text")[k].as_py()), shingles(y, batch.column("b_text")[k].as_py())
            if min(len(one), len(two)) < least * max(len(one), len(two)):
                continue
            common = len(np.intersect1d(one, two, assume_unique=True))
            if common >= least * (len(one) + len(two) - common):  # two empty sets are equal
                stay.append(k)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(stay, pa.int64())), batch.column("b").take(pa.array(stay, pa.int64()))], names=["a", "b"])


def _marked(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows whose text_hash may be asked for, found where they are read, so that not all texts are dealt out by key.
    The marks take 1 MB, whatever is asked."""
    place = F.pmod("text_hash", F.lit(MARKS * 32_768))
    marks = asked.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_marks"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(_marks, cast(_bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    rows = texts.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", at)
    return rows.join(F.broadcast(marks), "_bucket").filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) > 0).select(*texts.columns)


def compared(docs: DataFrame, pairs: DataFrame, *, text_col: str, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of text hashes whose texts are alike. `pairs` is read twice."""
    # an inner join: a semi join would be pushed below the marks, and all texts dealt out
    asked = pairs.select(F.col("a").alias("text_hash")).union(pairs.select("b")).distinct()
    texts = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("_text"))
    texts = stored(_marked(texts, asked).join(asked, "text_hash").groupBy("text_hash").agg(F.first("_text").alias("_text")))
    both = pairs.join(texts.select(F.col("text_hash").alias("a"), F.col("_text").alias("a_text")), "a").join(texts.select(F.col("text_hash").alias("b"), F.col("_text").alias("b_text")), "b")
    return both.mapInArrow(partial(_alike, words=words, least=least), "a long, b long")


def alike_links(docs: DataFrame, prints: DataFrame, *, text_col: str, words: int, radius: int, least: float, limit: int) -> DataFrame:
    """(a, b): hashes of texts linked by their exact similarity, among the nearest candidates of the sketches."""
    each = prints.groupBy("fp").agg(F.min("text_hash").alias("first"))
    near = print_links(prints, radius=radius, shards="sketch", limit=limit)
    near = near.join(each.select(F.col("fp").alias("a"), F.col("first").alias("_a")), "a").join(each.select(F.col("fp").alias("b"), F.col("first").alias("_b")), "b")
    near = near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    equal = prints.select("fp", "text_hash").join(each, "fp").filter("text_hash <> first").select(F.col("first").alias("a"), F.col("text_hash").alias("b"))
    return compared(docs, stored(near.unionByName(equal).distinct()), text_col=text_col, words=words, least=least)


def _often(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Shingles that a task meets in two texts or more, and in how many; texts are counted some thousands at once."""
    parts: list[np.ndarray] = []

    def counts():
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["key", "n"])

    size = 0
    for batch in batches:
        for value in batch.column("_text"):
            parts.append(np.unique(shingle_hashes((value.as_py() or "").encode(), words)))
            size += len(parts[-1])
            if size >= REMEMBERED:
                yield counts()
                parts, size = [], 0
    if parts:
        yield counts()


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, least: float, late: Broadcast) -> Iterator[pa.RecordBatch]:
    """key, text_hash, size (of the set of shingles) and place of the first shingles of every text; a text without
    any has one key of its own kind."""
    hot, rank = late.value  # sorted shingles, from 1 for the least frequent
    for batch in batches:
        keys, sizes, counts = [], [], []
        for value in batch.column("_text"):
            found = np.unique(shingle_hashes((value.as_py() or "").encode(), words))
            n = len(found)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                found = found[np.lexsort((found, np.where(hot[at] == found, rank[at], 0)))]
            keys.append(found[: n - int(np.ceil(least * n - 1e-9)) + 1] if n else np.zeros(1, dtype=np.uint64))
            sizes.append(n)
            counts.append(len(keys[-1]))
        if keys:
            place = np.concatenate([np.arange(c) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(batch.column("text_hash").to_numpy(), counts)), pa.array(np.repeat(sizes, counts).astype(np.int32)), pa.array(place.astype(np.int32))],
                names=["key", "text_hash", "size", "place"],
            )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, a few whole keys at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column("key").to_numpy()
        if key[0] == key[-1] and (len(held) == 1 or held[-2].column("key")[-1].as_py() == key[0]):
            continue  # no key ends in it
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and text_hash, one for each text of the keys that several texts have, with their number."""
    for table in _groups(batches):
        key, text = table.column("key").to_numpy(), table.column("text_hash").to_numpy()
        once = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
        _, at, n = np.unique(key[once], return_inverse=True, return_counts=True)
        many = n[at] > 1
        yield from table.take(pa.array(once[many])).append_column("crowd", pa.array(n[at][many], pa.int32())).combine_chunks().to_batches()


def _apart(bits: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function of a place and others: in how many bits the parities there differ, in the width of the narrower."""
    width = np.array([len(x) for x in bits])
    at = {w: np.full(len(bits), -1) for w in np.unique(width)}
    laid: dict[int, np.ndarray] = {}
    for w in sorted(at, reverse=True):  # the wider ones are folded down to each width
        own = np.flatnonzero(width == w)
        rows = [np.frombuffer(b"".join(bits[k] for k in own), dtype=np.uint64).reshape(len(own), -1)]
        at[w][own] = np.arange(len(own))
        wider = [v for v in laid if v > w]
        if wider:
            last = laid[min(wider)]
            for _ in range(int(min(wider) // w).bit_length() - 1):
                last = last[:, : last.shape[1] // 2] ^ last[:, last.shape[1] // 2 :]
            known = at[min(wider)]
            at[w] = np.where(known >= 0, known + len(own), at[w])
            rows.append(last)
        laid[w] = np.concatenate(rows)

    def apart(x: int, others: np.ndarray) -> np.ndarray:
        out = np.empty(len(others), dtype=np.int64)
        narrow = np.minimum(width[others], width[x])
        for w in np.unique(narrow):
            here = narrow == w
            out[here] = np.bitwise_count(laid[w][at[w][others[here]]] ^ laid[w][at[w][x]]).sum(axis=1, dtype=np.int64)
        return out

    return apart


def _across(batches: Iterator[pa.RecordBatch], least: float, first: bool, nearest: int = 0) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and label, the pairs of different labels that may be alike, or, if `first`, only those
    of the first text of every label with the first of the key. Sizes must fit, and so must what can follow the
    place of the key: of a pair that is alike, the first key that the two share passes. Where the rows have parity
    bits, those must fit too; with `nearest`, each text has so many pairs of a key at most, by these bits."""
    held: list[np.ndarray] = []
    count = 0

    def pairs():
        a, b = np.unique(np.concatenate(held), axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], names=["a", "b"])

    for table in _groups(batches):
        key, label, text, size, place = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "label", "text_hash", "size", "place"))
        bits = table.column("bits") if "bits" in table.schema.names else None
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        for low, high in zip(starts, ends, strict=True):
            if label[low] == label[high - 1]:
                continue
            new = low + np.flatnonzero(np.r_[True, label[low + 1 : high] != label[low : high - 1]])
            if first:
                blocks = [(np.array([low]), new[1:])]
            else:
                after = np.repeat(np.r_[new[1:], high], np.diff(np.r_[new, high]))
                blocks = ((np.array([x]), np.arange(after[x - low], high)) for x in range(low, new[-1]))
            sifted = bits is not None and bits[low].is_valid
            apart = _apart(bits.slice(low, high - low).to_pylist()) if sifted else None
            for x, y in blocks:
                most = np.minimum(size[x] - place[x], size[y] - place[y])
                fit = (most >= least * (size[x] + size[y] - most) - 1e-9) | (size[x] + size[y] == 0)
                y = y[fit]
                if sifted and len(y):
                    d = apart(int(x[0]) - low, y - low)
                    fit = d <= (1 - least) / (1 + least) * (size[x] + size[y]) + 1e-9
                    y, d = y[fit], d[fit]
                    if nearest and len(y) > nearest:
                        y = y[np.argpartition(d, nearest - 1)[:nearest]]
                held.append(np.stack([np.minimum(text[x], text[y]), np.maximum(text[x], text[y])], axis=1))
                count += len(y)
                if count >= PAIRS:
                    yield pairs()
                    held, count = [], 0
    if count:
        yield pairs()


def shared_prefixes(docs: DataFrame, *, text_col: str, words: int, least: float) -> DataFrame:
    """key, text_hash, size, place, crowd (texts that have the key): the first shingles of every text that another
    text has among its first too."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("_text"))
    every = max(1, -(-docs.count() // SAMPLE))
    counted = texts.filter(F.pmod("text_hash", F.lit(every)) == 0).mapInArrow(partial(_often, words=words), "key long, n long")
    late = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(LATE).collect()
    hot = np.array([r["key"] for r in late], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    late = spark.sparkContext.broadcast((hot[order], len(hot) - order))
    keyed = texts.mapInArrow(partial(_prefixes, words=words, least=least, late=late), "key long, text_hash long, size int, place int")
    laid = keyed.repartition(parts, "key").sortWithinPartitions("key", "text_hash")
    return stored(laid.mapInArrow(_shared, "key long, text_hash long, size int, place int, crowd int"))


def lossless_links(docs: DataFrame, prints: DataFrame, links: DataFrame, *, text_col: str, words: int, least: float) -> DataFrame:
    """`links` and what they lack to connect all texts that are alike. First each group of a key is compared with the
    first of the key; then, where a key is crowded, each text with the nearest two by their parity bits, which leaves
    little of a crowd; then all pairs of a key whose groups still differ and whose bits allow it."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shared = shared_prefixes(docs, text_col=text_col, words=words, least=least)
    crowd = shared.filter(F.col("crowd") > CROWD)
    bits = stored(prints.groupBy("text_hash").agg(F.first("bits").alias("bits")).join(crowd.select("text_hash").distinct(), "text_hash", "left_semi"))
    done = None
    for step in ("first", "nearest", "all"):
        roots = connected_groups(links, a="a", b="b").withColumnRenamed("id", "text_hash")
        rows = crowd if step == "nearest" else shared
        labelled = rows.join(roots, "text_hash", "left").withColumn("label", F.coalesce("root", "text_hash")).drop("root")
        if step != "first":
            labelled = labelled.join(bits, "text_hash", "left").withColumn("bits", F.when(F.col("crowd") > CROWD, F.col("bits")))
        laid = labelled.drop("crowd").repartition(parts, "key").sortWithinPartitions("key", "label", "text_hash")
        pairs = laid.mapInArrow(partial(_across, least=least, first=step == "first", nearest=2 * (step == "nearest")), "a long, b long").distinct()
        pairs = stored(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        more = compared(docs, pairs, text_col=text_col, words=words, least=least)
        links, done = cut_lineage(links.unionByName(more)), pairs if done is None else done.unionByName(pairs)
    return links


def first_of_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 13, least: float = 0.8, limit: int = 16_384) -> DataFrame:
    """The rows of `docs` that are the lowest of their component, texts being linked at a Jaccard similarity of
    `least` of their shingles. Fingerprints scatter: at 0.8 the expected distance is 9.7 of 64 bits, and 13 bits
    hold 91 % of the pairs (97 % at 0.85). Candidates are the nearest links of each sketch; each is compared exactly.
    What they leave out is found by shared prefixes of the sets of shingles, so that no link is lost."""
    prints = cut_lineage(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, sketches=SKETCHES))
    links = cut_lineage(alike_links(docs, prints, text_col=text_col, words=words, radius=radius, least=least, limit=limit))
    links = lossless_links(docs, prints, links, text_col=text_col, words=words, least=least)
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    member = prints.groupBy("text_hash").agg(F.min(rank).alias("low"))
    if not links.isEmpty():
        roots = connected_groups(links, a="a", b="b").withColumnRenamed("id", "text_hash")
        member = member.join(roots, "text_hash", "left").groupBy(F.coalesce("root", "text_hash").alias("root")).agg(F.min("low").alias("low"))
    stays = member.select(F.col("low.doc_id").alias("_stay"), F.col("low.text_hash").alias("_hash"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").alias("_key"), F.xxhash64(F.col(f"`{text_col}`")).alias("_print"))
    return held.join(stays, F.col("_key").eqNullSafe(F.col("_stay")) & (F.col("_print") == F.col("_hash")), "left_semi").select("_doc.*")
