"""Encoding by pair merges through a table of last tokens, and decoding.

Merging takes, again and again, the adjacent pair whose joined piece scores highest (the leftmost of equal
ones). No merge crosses the border of two final tokens, so the encoding of a prefix that ends on such a
border is a prefix of the encoding, and every prefix of a text has exactly one last token: a vocabulary
piece at its end (an automaton finds them all) that follows the last token of what is before it, where the
two are compatible, that is, merging their joined letters gives just these two. One pass from left to right
fills the table, one pass backwards reads the ids from it; the work grows with the length, not its square.

Texts fall into stretches no piece can span (white space begins one, a letter in no longer piece is one of
its own), so stretches are encoded once and remembered.
"""

from __future__ import annotations

import codecs
import re
from itertools import chain

import numpy as np

SPACE = "▁"
#: Stretches and pairs a worker remembers; longer stretches are encoded each time.
REMEMBERED, PAIRS, LONGEST = 500_000, 1_000_000, 64


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """Every byte that begins no letter is one replacement character."""
    return "�", error.start + 1


codecs.register_error("vidspark-each-byte", _each_byte)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class PrefixTable:
    """Ids of texts and texts of ids for a merge model with byte fallback, read from its file.

    Holds for models that take texts as they are but for one space put before them, as piece_bpe_32k.model
    does; others are refused."""

    ready: dict[str, PrefixTable] = {}  # by file: a worker keeps what it knows from task to task

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = "ﬁ Ａ  b "
        size = model.vocab_size()
        if model.Normalize(probe) != SPACE + probe.replace(" ", SPACE) or any(model.IsUnused(k) for k in range(size)):
            raise ValueError(f"{path}: only models without normalisation and unused pieces")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, bytes] = {}
        self.surface: list[bytes] = [b""] * size
        self.spaced = np.zeros(size, dtype=bool)
        self.byte = [-1] * 256
        for k in range(size):
            piece = model.IdToPiece(k)
            if model.IsByte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.surface[k] = bytes([int(piece[3:5], 16)])
            elif model.IsUnknown(k):
                self.surface[k] = " ⁇ ".encode()
            elif not model.IsControl(k):
                self.score[piece], self.ids[piece] = model.GetScore(k), _packed([k])
                self.surface[k] = piece.replace(SPACE, " ").encode()
                self.spaced[k] = piece.startswith(SPACE)
        if -1 in self.byte:
            raise ValueError(f"{path}: only models with byte fallback")
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.follows: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, float]] | None] = {}
        self.known: dict[str, bytes] = {}
        self.stretches = self._stretches()

    @classmethod
    def of(cls, path: str) -> PrefixTable:
        if path not in cls.ready:
            cls.ready[path] = cls(path)
        return cls.ready[path]

    def _stretches(self) -> re.Pattern:
        longer = [p for p in self.score if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return re.compile(r"[\s\S]+")
        joined = set(chain.from_iterable(longer))
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in joined))
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]") if alone else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Tokens of a short text by merging alone, or what is left when only `until` are."""
        parts, score = list(text), self.score
        while len(parts) > until:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def half(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge is the piece; none where merging its letters does not give the piece."""
        if piece not in self.halves:
            left = self.merged(piece, until=2)
            self.halves[piece] = (left[0], left[1]) if len(left) == 2 and self.merged(piece) == [piece] else None
        return self.halves[piece]

    def stable(self, piece: str) -> bool:
        """Whether merging the letters of a piece gives the piece."""
        return len(piece) == 1 or self.half(piece) is not None

    def edge(self, token: str, side: int) -> list[tuple[str, float]] | None:
        """The tokens that stand at one end (0 left, 1 right) while the letters of `token` merge, each with
        the score of the merge that takes it up; none where a merge scores above one it needs."""
        key = (token, side)
        if key not in self.edges:
            out: list[tuple[str, float]] | None = [(token, -np.inf)]
            if len(token) > 1:
                parts, own = self.half(token), self.score[token]
                inner = [self.edge(p, side) for p in parts]
                if None in inner or any(len(p) > 1 and self.score[p] <= own for p in parts):
                    out = None
                else:
                    out = [*inner[side][:-1], (parts[side], own), (token, -np.inf)]
            self.edges[key] = out
        return self.edges[key]

    def kept_apart(self, left: str, right: str) -> bool:
        """Whether merging the joined letters of two tokens keeps the border between them: at no time may
        the pair across it score above the next merge on its left and at least like the one on its right."""
        ends, heads = self.edge(left, 1), self.edge(right, 0)
        if ends is None or heads is None:
            return self.merged(left + right) == [left, right]
        score, i, j = self.score, 0, 0
        while True:
            (x, gone_x), (y, gone_y) = ends[i], heads[j]
            across = score.get(x + y)
            if across is not None and across > gone_x and across >= gone_y:
                return False
            if gone_x == gone_y == -np.inf:
                return True
            if gone_x >= gone_y:
                i += 1
            else:
                j += 1

    def tokens(self, text: str) -> list[str]:
        """Tokens of a stretch; a letter outside the vocabulary is a token of its own."""
        if self.pairs >= PAIRS:
            self.follows.clear()
            self.pairs = 0
        last, after = [""], [self.follows.setdefault("", {})]
        for end, piece in self.automaton.iter(text):
            while len(last) <= end:
                self._fill(text[len(last) - 1], last, after)
            if len(last) > end + 1:
                continue
            start = end + 1 - len(piece)
            fits = after[start].get(piece)
            if fits is None:
                fits = after[start][piece] = self.kept_apart(last[start], piece) if start else self.stable(piece)
                self.pairs += 1
            if fits:
                self._fill(piece, last, after)
        while len(last) <= len(text):
            self._fill(text[len(last) - 1], last, after)
        out, k = [], len(text)
        while k:
            out.append(last[k])
            k -= len(last[k])
        return out[::-1]

    def _fill(self, token: str, last: list[str], after: list[dict[str, bool]]) -> None:
        last.append(token)
        known = self.follows.get(token)
        if known is None:
            known = self.follows[token] = {}
        after.append(known)

    def stretch_ids(self, stretch: str) -> bytes:
        return b"".join([self.ids.get(t) or _packed([self.byte[b] for b in t.encode()]) for t in self.tokens(stretch)])

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        stretches = self.stretches.findall(SPACE + text.replace(" ", SPACE)) if text else []
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        for s in set(stretches).difference(known):
            if len(s) <= LONGEST:
                known[s] = self.stretch_ids(s)
        return _packed([self.begin] * begin) + b"".join([known.get(s) or self.stretch_ids(s) for s in stretches]) + _packed([self.end] * end)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes joined, the space before the text taken off, marks dropped."""
        surface, kinds = self.surface, ids.tolist()
        data = b"".join(map(surface.__getitem__, kinds))
        first = next((k for k in kinds if surface[k]), None)
        return (data[1:] if first is not None and self.spaced[first] else data).decode("utf-8", "vidspark-each-byte")
