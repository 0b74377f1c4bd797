"""Counts of words, word pairs and word triples of texts, asked for by block and answered by part.

Texts are kept as blocks: a million tokens or so as places in the block's own dictionary. A block never sends
its tokens. It sends each different word, pair or triple once, dealt over parts by key, and gets back, in the
same order, what the whole corpus says of it: the rows of a shuffle are packed arrays, the lowest bytes of all numbers together.

1. words: hash -> number of the word (part and rank by count within the part), count, log of the spelling;
2. pairs (v, w): count, and of v the number of different next words and whether it passes the test;
3. triples (u, v, w) of contexts that can still pass the test by their count: count, and of (u, v) the number
   of different next words if it passes, and of v whether any (u, v) does.

The part of a pair or triple is that of v. Words and contexts that are a quarter of a part's share of the
corpus by themselves (at most four times as many as there are parts) are dealt by the words beside them instead; the
sums for these alone go through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.session import stored

#: Tokens of a block and, on average, of a part: what a task holds at once.
BLOCK, PART = 1_000_000, 2_000_000
#: Words of the table that a task deals out together.
HELD = 400_000
ANSWER = "home int, block long, part int, round int, body binary, key long, k long, t long, a double, b double"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one value: of each array the lowest bytes first, up to the highest that is in use, compressed."""
    wide = [max(1, int(a.max()).bit_length() + 7 >> 3) if a.dtype.kind == "u" and len(a) else a.itemsize for a in arrays]
    head = np.array([len(arrays), *(x for a, k in zip(arrays, wide, strict=True) for x in (ord(a.dtype.char), len(a), k))], dtype=np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)[:, :k].T.tobytes() for a, k in zip(arrays, wide, strict=True))
    return head + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(body: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 3 * count, 8).reshape(count, 3).tolist()
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(body)[8 + 24 * count :], sum(n * k for _, n, k in head)), np.uint8)
    low, out = 0, []
    for kind, n, k in head:
        dtype = np.dtype(chr(kind))
        x = np.zeros((n, dtype.itemsize), dtype=np.uint8)
        x[:, :k] = planes[low : low + n * k].reshape(k, n).T
        out.append(x.view(dtype).reshape(n))
        low += n * k
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys in order, where one of each is, the place of every key among them). Keys are not negative."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits < 64:  # key and place as one number: sorted faster than by places
        order = np.sort((keys << bits) | np.arange(len(keys)))
        keys, order = order >> bits, (order & ((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, dtype=bool)
    place = np.empty(len(keys), dtype=order.dtype)
    place[order] = np.cumsum(new, dtype=order.dtype) - 1
    return keys[new], order[new], place


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, the first from 0."""
    return np.diff(x, prepend=x.dtype.type(0))


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, dtype=np.int64)


def _log(x: np.ndarray) -> np.ndarray:
    """Natural log; 0 where there is nothing."""
    return np.log(np.maximum(x, 1), dtype=np.float64)


@dataclass(frozen=True)
class Plan:
    """What blocks and parts must agree on. `n`, `once`: training tokens, and how many of them occur once."""

    parts: int
    homes: dict[int, int]
    n: int
    once: int
    order: int
    cost: float
    seen: int

    @property
    def width(self) -> int:
        """Bits of the rank in a word's number."""
        return 32 - self.parts.bit_length()

    @property
    def counts(self) -> type:
        """For counts of tokens; twice as many take no more."""
        return np.int32 if self.n < 1 << 30 else np.int64

    @property
    def hot(self) -> int:
        return max(self.n // (4 * self.parts), self.seen)

    @property
    def toll(self) -> float:
        """What each different next word costs."""
        return self.cost * math.log(max(self.n, 2))

    def passes(self, t, k, a, b):
        """t tokens behind a context, k different; a: sum of n log n over these, b: of n log p, p under the parent."""
        return (t >= self.seen) & (a - b - t * _log(t) > self.toll * k)


def dealt(dest: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by part, bounds of the parts in it)."""
    order = np.argsort(dest.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
    return order, np.r_[0, np.cumsum(np.bincount(dest.astype(np.int64), minlength=parts))]


class Block:
    """A block of texts with the answers it has so far."""

    def __init__(self, plan: Plan, tokens: bytes, answers: dict[int, list[bytes]], hot: tuple[dict, dict, frozenset] = ({}, {}, frozenset())):
        self.plan, self.answers = plan, answers
        self.heavy, self.heavy_contexts, self.heavy_parents = hot
        w, self.lengths, held = unpacked(tokens)
        got = [unpacked(x) for x in answers[1]]
        number = np.concatenate([x[0] for x in got]).astype(np.uint64)
        count = np.concatenate([x[1] for x in got]).astype(np.int64)
        spelled = np.zeros(len(count))
        spelled[count == 0] = np.concatenate([x[2] for x in got])
        #: places in the dictionary in the order of the words' numbers; place 0 is the start of a text
        self.sorted = np.argsort(number)
        self.number, self.count, self.spelled = (np.r_[x.dtype.type(0), x[self.sorted]] for x in (number, count.astype(self.plan.counts), spelled))
        place = np.empty(len(number), dtype=np.int32)
        place[self.sorted] = np.arange(1, len(number) + 1)
        self.w, self.shift = place[w], len(number).bit_length()
        self.start = np.r_[0, np.cumsum(self.lengths.astype(np.int64))[:-1]]
        # every text has one end, so the texts of the corpus that begin are the ends in it
        self.count[0] = self.count[self.w[self.lengths[0] - 1]]
        self.train = np.repeat(held == 0, self.lengths)

    def before(self, x: np.ndarray) -> np.ndarray:
        """Of each token the one before, or the start."""
        v = np.r_[x.dtype.type(0), x[:-1]]
        v[self.start] = 0
        return v

    @cached_property
    def v(self) -> np.ndarray:
        return self.before(self.w)

    def part(self, number: np.ndarray) -> np.ndarray:
        return number >> np.uint64(self.plan.width)

    @cached_property
    def pairs(self):
        """Positions, keys (v, w), key of each position; by key: place of v, place of w, heavy; order and bounds by part."""
        at = np.flatnonzero(self.count[self.v] >= self.plan.seen).astype(np.int32)
        keys, _, inverse = distinct((self.v[at].astype(np.int64) << self.shift) | self.w[at])
        v, w = (keys >> self.shift).astype(np.int32), (keys & ((1 << self.shift) - 1)).astype(np.int32)
        heavy = self.count[v] >= self.plan.hot
        order, bounds = dealt(self.part(self.number[np.where(heavy, w, v)]), self.plan.parts)
        return at, (self.number[v] << np.uint64(32)) | self.number[w], inverse, v, w, heavy, order, bounds

    def ask_pairs(self) -> Iterator[tuple[int, bytes]]:
        at, keys, inverse, _, w, heavy, order, bounds = self.pairs
        n, rest = (np.bincount(inverse[x], minlength=len(keys)).astype(np.uint64) for x in (self.train[at], ~self.train[at]))
        of_w = self.count[w].astype(np.uint64)
        for p in np.flatnonzero(np.diff(bounds)):
            mine = order[bounds[p] : bounds[p + 1]]
            yield int(p), packed(*(y for x in (mine[~heavy[mine]], mine[heavy[mine]]) for y in (steps(keys[x]), n[x], rest[x], of_w[x])))

    @cached_property
    def told(self):
        """Of each position: count of the pair, whether nobody else asked for it; by place: different next words, whether v passes."""
        kinds, kept = np.zeros(len(self.count), dtype=np.int64), np.zeros(len(self.count), dtype=bool)
        pair, alone = np.zeros(len(self.w), dtype=self.plan.counts), np.zeros(len(self.w), dtype=bool)
        if self.plan.order < 1:
            return pair, alone, kinds, kept
        at, keys, inverse, v, _, heavy, order, bounds = self.pairs
        code = np.empty(len(keys), dtype=np.uint64)
        for p, body in zip(np.flatnonzero(np.diff(bounds)), self.answers.get(2, ()), strict=True):
            mine = order[bounds[p] : bounds[p + 1]]
            light = mine[~heavy[mine]]
            code[light], of_v, code[mine[heavy[mine]]] = unpacked(body)
            place = v[light[firsts(v[light])]]
            kinds[place], kept[place] = of_v >> np.uint64(1), of_v & np.uint64(1)
        for place in np.flatnonzero(self.count >= self.plan.hot):
            kinds[place], kept[place] = self.heavy.get(int(self.number[place]), (0, False))
        count = np.maximum(code.astype(self.plan.counts) - 1, 0)[inverse]
        alone[at] = (code == 0)[inverse]
        pair[at] = np.where(alone[at], self.train[at], count)
        return pair, alone, kinds, kept

    @cached_property
    def contexts(self):
        """Contexts (u, v) that can pass by their count, keys v << 32 | u, and triples below them."""
        pair, alone, _, kept = self.told
        t = self.before(pair)  # 0 at the start of a text, which has the counts of its parent and never passes
        if self.plan.order < 2:
            t[:] = 0
        # p of a next word is n / count of v at least, so the gain is t log(count of v / t) at most
        at = np.flatnonzero(t >= self.plan.seen)
        at = at[t[at] * (_log(self.count[self.v[at]]) - _log(t[at])) > self.plan.toll * (1 - 1e-9)].astype(np.int32)
        contexts, first, inverse = distinct((self.v[at].astype(np.int64) << self.shift) | self.before(self.v)[at])
        v, u = (contexts >> self.shift).astype(np.int32), contexts & ((1 << self.shift) - 1)
        heavy = t[at[first]] >= self.plan.hot
        single = alone[at] & ~heavy[inverse]
        sent = np.flatnonzero((pair[at] > 0) & ~single)
        keys, head, triple = distinct((inverse[sent].astype(np.int64) << self.shift) | self.w[at[sent]])
        context, w = (keys >> self.shift).astype(np.int32), (keys & ((1 << self.shift) - 1)).astype(np.int32)
        # a part tells of v whether a context (u, v) passes; words without a context of their own here ask by one that has no next words
        lone = np.zeros(len(self.count), dtype=bool)
        lone[self.v] = True
        lone &= ~kept & (self.count > self.plan.seen) & (self.count < self.plan.hot) & (self.plan.order > 1)
        lone[v[~heavy]] = False
        self.asked = SimpleNamespace(
            t=t, at=at, v=v, key=(self.number[v] << np.uint64(32)) | self.number[u], inverse=inverse, heavy=heavy, single=single,
            sent=sent, context=context, w=self.number[w], head=head, triple=triple, lone=np.flatnonzero(lone),
        )
        own = self.part(self.number[np.where(self.count[v] >= self.plan.hot, u, v)])
        light = np.flatnonzero(~heavy)
        of_triple = np.where(heavy[context], self.part(self.number[w]), own[context])
        self.deal = light, *dealt(own[light], self.plan.parts), *dealt(of_triple, self.plan.parts), *dealt(self.part(self.number[self.asked.lone]), self.plan.parts)
        return self.asked

    def _shares(self) -> Iterator[tuple]:
        """part, its contexts, lone words, triples of its contexts, triples of heavy contexts."""
        x = self.contexts
        light, by, bounds, by3, bounds3, by_lone, bounds_lone = self.deal
        for p in np.flatnonzero(np.diff(bounds) + np.diff(bounds3) + np.diff(bounds_lone)):
            mine = by3[bounds3[p] : bounds3[p + 1]]
            shared = x.heavy[x.context[mine]]
            yield int(p), light[by[bounds[p] : bounds[p + 1]]], x.lone[by_lone[bounds_lone[p] : bounds_lone[p + 1]]], mine[~shared], mine[shared]

    def ask_contexts(self) -> Iterator[tuple[int, bytes]]:
        x, pair = self.contexts, self.told[0]
        singles = np.bincount(x.inverse[x.single & self.train[x.at]], minlength=len(x.key)).astype(np.uint64)
        n = np.bincount(x.triple[self.train[x.at[x.sent]]], minlength=len(x.w)).astype(np.uint64)
        of_pair = pair[x.at[x.sent[x.head]]].astype(np.uint64)
        of_v = self.count[x.v].astype(np.uint64)
        for p, own, lone, mine, shared in self._shares():
            place = np.searchsorted(own, x.context[mine]).astype(np.uint64) << np.uint64(32)
            heavy, there = np.unique(x.context[shared], return_inverse=True)
            yield p, packed(
                steps(x.key[own]), singles[own], of_v[own[firsts(x.v[own])]], steps(place | x.w[mine]), n[mine], of_pair[mine], steps(self.number[lone]),
                x.key[heavy], of_v[heavy], steps((there.astype(np.uint64) << np.uint64(32)) | x.w[shared]), n[shared], of_pair[shared],
            )

    def logs(self) -> np.ndarray:
        """Natural log of the probability of every token in the state of its longest retained suffix."""
        plan, x = self.plan, self.contexts
        pair, _, kinds, kept = self.told
        n, of_context, kept = np.zeros(len(x.w)), np.zeros(len(x.key)), kept.copy()
        for (_, own, lone, mine, shared), body in zip(self._shares(), self.answers.get(3, ()), strict=True):
            n[mine], of_context[own], parent, of_lone, n[shared] = unpacked(body)
            v = x.v[own]
            kept[v[firsts(v)]] |= parent > 0
            kept[lone] |= of_lone > 0
        for k in np.flatnonzero(x.heavy):
            of_context[k] = self.heavy_contexts.get(int(x.key[k]), 0)
        for place in np.flatnonzero(self.count >= plan.hot):
            kept[place] |= int(self.number[place]) in self.heavy_parents
        c = self.count
        p = (np.where(c > 0, c, plan.once) / (plan.n + plan.once))[self.w]
        if plan.order > 0:
            k = np.where(kept, kinds, 0)[self.v]
            p = np.where(k > 0, (pair + k * p) / np.maximum(c[self.v] + k, 1), p)
        k = of_context[x.inverse]
        seen = np.where(x.single, self.train[x.at], 0).astype(np.float64)
        seen[x.sent] = n[x.triple]
        p[x.at] = np.where(k > 0, (seen + k * p[x.at]) / (x.t[x.at] + k), p[x.at])
        return np.log(p)


def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """home, block, part, round, body; then, where there are some, sums of words or contexts that have shares in several parts."""
    if rows:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = [x.split()[0] for x in ANSWER.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def row(home: int, block: int, part: int, at: int, body: bytes) -> tuple:
    return home, block, part, at, body, None, None, None, None, None


def _ask_words(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, hashes in zip(b.column("block").to_pylist(), b.column("hashes"), strict=True):
            x = np.cumsum(unpacked(hashes.as_py())[0], dtype=np.uint64)
            part = ((x >> np.uint64(32)) * np.uint64(plan.parts)) >> np.uint64(32)
            low = firsts(part)
            yield from batch([row(plan.homes[block], block, int(part[i]), 1, packed(steps(x[i:j]))) for i, j in zip(low, [*low[1:], len(x)], strict=True)])


def _deal_words(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    def deal():
        x, c, spelled = (np.concatenate(y) for y in zip(*parts, strict=True))
        order = np.argsort(x)
        x, c, spelled = x[order], c[order], spelled[order]
        part = ((x >> np.uint64(32)) * np.uint64(plan.parts)) >> np.uint64(32)
        low = firsts(part)
        yield from batch([row(0, -1, int(part[i]), 0, packed(steps(x[i:j]), c[i:j], spelled[i:j][c[i:j] == 0])) for i, j in zip(low, [*low[1:], len(x)], strict=True)])

    parts, size = [], 0
    for b in batches:
        parts.append((b.column("w").to_numpy().view(np.uint64), b.column("c").to_numpy().astype(np.uint64), b.column("spelled").to_numpy(zero_copy_only=False)))
        size += b.num_rows
        if size >= HELD:
            yield from deal()
            parts, size = [], 0
    if size:
        yield from deal()


def _by_part(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, int, bytes]]]:
    """home, block, body of a part's rows, in the order of the blocks."""
    out: dict[int, list] = {}
    for b in batches:
        for home, block, part, body in zip(*(b.column(x).to_pylist() for x in ("home", "block", "part", "body")), strict=True):
            out.setdefault(part, []).append((home, block, body))
    return {part: sorted(x, key=lambda y: y[1]) for part, x in out.items()}


def _answer_words(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for part, rows in _by_part(batches).items():
        table = []
        for x, c, s in (unpacked(body) for _, block, body in rows if block < 0):
            spelled = np.zeros(len(x))
            spelled[c == 0] = s
            table.append((np.cumsum(x, dtype=np.uint64), c, spelled))
        x, c, spelled = (np.concatenate(y) for y in zip(*table, strict=True))
        order = np.lexsort((x, -c.astype(np.int64)))
        rank = np.empty(len(x), dtype=np.int64)
        rank[order] = np.arange(1, len(x) + 1)
        if len(x) >> plan.width:
            raise ValueError(f"{len(x)} words in one of {plan.parts} parts")
        number = (np.uint32(part << plan.width) | rank.astype(np.uint32)).astype(np.uint32)
        order = np.argsort(x)
        x, c, spelled, number = x[order], c[order], spelled[order], number[order]
        for home, block, body in rows:
            if block >= 0:
                at = np.searchsorted(x, np.cumsum(unpacked(body)[0], dtype=np.uint64))
                yield from batch([row(home, block, part, 1, packed(number[at], c[at], spelled[at][c[at] == 0]))])


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`distinct` for keys of 64 bits."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, dtype=bool)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[new], order[new], place


def _joined(bodies: list[list[np.ndarray]], k: int) -> np.ndarray:
    return np.concatenate([x[k] for x in bodies])


def _pair_sums(keys: np.ndarray, n: np.ndarray, rest: np.ndarray, of_w: np.ndarray, plan: Plan):
    """Of the pairs asked: 0 where it was asked once, else 1 + count; by different v in order: v, different next words, tokens, sums of n log n and n log p."""
    all_keys, first, inverse = _unique(keys)
    n, rest = (np.bincount(inverse, weights=x, minlength=len(all_keys)) for x in (n, rest))
    v = firsts(all_keys >> np.uint64(32))
    own = lambda x: np.add.reduceat(x, v) if len(v) else x[:0]
    code = np.where(n + rest == 1, 0, n + 1).astype(np.uint64)
    return code[inverse], all_keys[v] >> np.uint64(32), own((n > 0).astype(np.int64)), own(n), own(n * _log(n)), own(n * (_log(of_w[first]) - math.log(max(plan.n, 1))))


def _answer_pairs(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for part, rows in _by_part(batches).items():
        bodies = [unpacked(body) for _, _, body in rows]
        for x in bodies:
            x[0], x[4] = (np.cumsum(x[k], dtype=np.uint64) for k in (0, 4))
        code, vs, k, t, a, b = _pair_sums(*(_joined(bodies, i) for i in range(4)), plan)
        of_v = ((k << 1) | plan.passes(t, k, a, b)).astype(np.uint64)
        shared, heavy, *sums = _pair_sums(*(_joined(bodies, i) for i in range(4, 8)), plan)
        yield from batch([(None, None, None, None, None, int(v), int(k), int(t), float(a), float(b)) for v, k, t, a, b in zip(heavy, *sums, strict=True)])
        low = low_shared = 0
        for (home, block, _), x in zip(rows, bodies, strict=True):
            high, high_shared = low + len(x[0]), low_shared + len(x[4])
            v = x[0] >> np.uint64(32)
            yield from batch([row(home, block, part, 2, packed(code[low:high], of_v[np.searchsorted(vs, v[firsts(v)])], shared[low_shared:high_shared]))])
            low, low_shared = high, high_shared


def _context_sums(contexts, singles, of_v, triples, n, of_pair):
    """Of the triples asked, the count; by context: different next words, tokens, sums of n log n and n log p."""
    all_triples, first, inverse = _unique(triples)
    n = np.bincount(inverse, weights=n, minlength=len(all_triples))
    context = (all_triples >> np.uint64(32)).astype(np.int64)
    own = lambda x: np.bincount(context, weights=x, minlength=len(contexts))
    k, t = own(n > 0) + singles, own(n) + singles
    return n[inverse].astype(np.uint64), k, t, own(n * _log(n)), own(n * _log(of_pair[first])) - t * _log(of_v)


def _answer_contexts(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    low32 = np.uint64(32)

    def numbered(bodies: list[list[np.ndarray]], key: int, triple: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different contexts, the place among them of each that is asked, triples under these places)."""
        contexts, place = np.unique(_joined(bodies, key), return_inverse=True)
        out, low = [], 0
        for x in bodies:
            own = place[low : low + len(x[key])].astype(np.uint64)
            out.append((own[(x[triple] >> low32).astype(np.int64)] << low32) | (x[triple] & np.uint64(0xFFFFFFFF)))
            low += len(x[key])
        return contexts, place, np.concatenate(out)

    for part, rows in _by_part(batches).items():
        bodies = [unpacked(body) for _, _, body in rows]
        for x in bodies:
            for k in (0, 3, 6, 9):
                x[k] = np.cumsum(x[k], dtype=np.uint64)
            v = x[0] >> low32
            x[2] = np.repeat(x[2], np.diff(np.r_[firsts(v), len(v)]))
        contexts, place, triples = numbered(bodies, 0, 3)
        of_v = np.empty(len(contexts), dtype=np.uint64)
        of_v[place] = _joined(bodies, 2)
        n, k, *sums = _context_sums(contexts, np.bincount(place, weights=_joined(bodies, 1), minlength=len(contexts)), of_v, triples, _joined(bodies, 4), _joined(bodies, 5))
        kept = plan.passes(sums[0], k, *sums[1:])
        of_context = np.where(kept, k, 0).astype(np.uint64)
        parents = np.unique(contexts[kept] >> low32)
        stats = [(int(x), None, None, None, None) for x in np.unique(contexts[kept & (of_v >= plan.hot)] >> low32)]
        heavy, there, shared = numbered(bodies, 7, 9)
        of_heavy = np.empty(len(heavy), dtype=np.uint64)
        of_heavy[there] = _joined(bodies, 8)
        n_shared, *sums = _context_sums(heavy, np.zeros(len(heavy)), of_heavy, shared, _joined(bodies, 10), _joined(bodies, 11))
        stats += [(int(np.uint64(x).view(np.int64)), int(k), int(t), float(a), float(b)) for x, k, t, a, b in zip(heavy, *sums, strict=True)]
        yield from batch([(None, None, None, None, None, *x) for x in stats])
        low = low3 = low_shared = 0
        for (home, block, _), x in zip(rows, bodies, strict=True):
            high, high3, high_shared = low + len(x[0]), low3 + len(x[3]), low_shared + len(x[9])
            v = x[0] >> low32
            yield from batch([row(home, block, part, 3, packed(n[low3:high3], of_context[place[low:high]], np.isin(v[firsts(v)], parents), np.isin(x[6], parents), n_shared[low_shared:high_shared]))])
            low, low3, low_shared = high, high3, high_shared


def gathered(batches: Iterator[pa.RecordBatch], plan: Plan, hot: tuple) -> Iterator[tuple[Block, dict]]:
    """Each block with its answers, and its row. Rows come sorted by block, round and part, the block's own first."""
    own, answers = None, {}
    for b in batches:
        for k, at in enumerate(b.column("round").to_pylist()):
            if not at:
                if own:
                    yield Block(plan, own["tokens"], answers, hot), own
                own, answers = {x: b.column(x)[k].as_py() if x in ("block", "tokens", "hashes") else b.column(x)[k].values for x in b.schema.names if x not in ("home", "part", "round", "body")}, {}
            else:
                answers.setdefault(at, []).append(b.column("body")[k].as_py())
    if own:
        yield Block(plan, own["tokens"], answers, hot), own


def _ask(batches: Iterator[pa.RecordBatch], plan: Plan, hot: tuple, at: int) -> Iterator[pa.RecordBatch]:
    for block, own in gathered(batches, plan, hot):
        asked = block.ask_pairs() if at == 2 else block.ask_contexts()
        yield from batch([row(plan.homes[own["block"]], own["block"], p, at, body) for p, body in asked])


def answered(blocks: DataFrame, words: DataFrame, *, n: int, once: int, order: int, cost: float, seen: int) -> tuple[DataFrame, Plan, tuple]:
    """(rows for `gathered`, its plan, its words and contexts with shares in several parts). `blocks`: block, tokens
    (packed words, lengths and held-out flags), hashes (packed steps of the rising hashes of the dictionary), other lists;
    `words`: w, c, spelled of every word."""
    spark = blocks.sparkSession
    ids = sorted(r["block"] for r in blocks.select("block").collect())
    parts = max(spark.sparkContext.defaultParallelism, -(-n // PART))
    homes = max(1, min(len(ids), 4 * parts))
    plan = Plan(parts, {x: k % homes for k, x in enumerate(ids)}, n, once, order, cost, seen)

    def round_of(asked: DataFrame, answer) -> tuple[DataFrame, DataFrame]:
        got = stored(asked.repartitionById(parts, "part").mapInArrow(partial(answer, plan=plan), ANSWER), tidy=True)
        sums = got.filter("key is not null").groupBy("key").agg(*[F.sum(x).alias(x) for x in "ktab"])
        return got.filter("block is not null").select("home", "block", "part", "round", "body"), sums

    # as Arrow: it starts no Python workers beside those of the blocks
    home = F.broadcast(spark.createDataFrame(pa.table({"block": pa.array(ids, pa.int64()), "home": pa.array([plan.homes[x] for x in ids], pa.int32())})))

    def together(*columns: str) -> DataFrame:
        rows = blocks.select("block", *columns).join(home, "block").withColumn("part", F.lit(-1)).withColumn("round", F.lit(0))
        for x in answers:
            rows = rows.unionByName(x, allowMissingColumns=True)
        return rows.repartitionById(homes, "home").sortWithinPartitions("block", "round", "part")

    asked = blocks.select("block", "hashes").mapInArrow(partial(_ask_words, plan=plan), ANSWER)
    answers = [round_of(asked.unionByName(words.select("w", "c", "spelled").mapInArrow(partial(_deal_words, plan=plan), ANSWER)), _answer_words)[0]]
    hot = ({}, {}, frozenset())
    if order > 0:
        got, sums = round_of(together("tokens").mapInArrow(partial(_ask, plan=plan, hot=hot, at=2), ANSWER), _answer_pairs)
        answers.append(got)
        hot = ({r["key"]: (r["k"], bool(plan.passes(r["t"], r["k"], r["a"], r["b"]))) for r in sums.collect()}, {}, frozenset())
    if order > 1:
        got, sums = round_of(together("tokens").mapInArrow(partial(_ask, plan=plan, hot=hot, at=3), ANSWER), _answer_contexts)
        answers.append(got)
        rows = sums.collect()
        contexts = {r["key"] & (2**64 - 1): r["k"] for r in rows if r["k"] is not None and plan.passes(r["t"], r["k"], r["a"], r["b"])}
        hot = (hot[0], contexts, frozenset([r["key"] for r in rows if r["k"] is None] + [x >> 32 for x in contexts]))
    return together(*[x for x in blocks.columns if x != "block"]), plan, hot
