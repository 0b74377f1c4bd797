"""Bin completion branch-and-bound on a histogram of lengths.

Items of one length are interchangeable, so a packing is a list of (filling, number of sequences) and
the search works on at most `capacity` counts however many items there are. A node takes the largest
length left and enumerates its undominated fillings: a filling is dropped if some of its items could be
replaced by one free item that is at least as long and still fits. The filling is used as often as the
counts allow. A branch is cut when its waste leaves no room below the incumbent, which best-fit
decreasing gives first. The search stops at the lower bound ceil(sum / capacity), or after a number of
nodes; it never returns more sequences than best-fit.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import combinations

Filling = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing, whole groups of equal sequences at a time."""
    open_bins: dict[int, list[list]] = {}  # room left -> [items, number]
    rooms: list[int] = []
    closed: list[Filling] = []

    def put(room: int, items: tuple[int, ...], number: int) -> None:
        if not room:
            closed.append((items, number))
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([items, number])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, items, number = capacity, (), -(-left // (capacity // length))
            else:
                room = rooms[at]
                items, number = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            each = min(room // length, left)
            full = min(number, left // each)
            put(room - each * length, items + (length,) * each, full)
            left -= full * each
            number -= full
            if number and left:  # fewer items than one sequence takes
                put(room - left * length, items + (length,) * left, 1)
                number, left = number - 1, 0
            if number and items:
                put(room, items, number)
    return closed + [(items, number) for groups in open_bins.values() for items, number in groups]


def _dominated(items: tuple[int, ...], waste: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Some items (not the first) fit where one longer free item would."""
    rest = items[1:]
    for size in range(1, len(rest) + 1):
        for part in set(combinations(rest, size)):
            low = sum(part) + (size == 1)
            for x in lengths[bisect_left(lengths, low) : bisect_right(lengths, sum(part) + waste)]:
                if x <= items[0] and counts[x] > items.count(x):
                    return True
    return False


def fillings(first: int, lengths: list[int], counts: dict[int, int], capacity: int, *, waste: int, most: int, steps: int) -> list[tuple[int, ...]]:
    """Undominated fillings around `first` that waste at most `waste`, least waste and longest items first;
    at most `most`, found within `steps` steps."""
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [steps]

    def grow(items: tuple[int, ...], room: int) -> bool:
        """Depth first, longest next item first. True: enough."""
        budget[0] -= 1
        if budget[0] < 0:
            return True
        top = min(items[-1], room)
        at = bisect_right(lengths, top) - 1
        extended = False
        while at >= 0:
            x = lengths[at]
            if counts[x] > items.count(x):
                extended = True
                if grow((*items, x), room - x):
                    return True
            at -= 1
        if not extended and room <= waste and not (len(items) <= 8 and _dominated(items, room, lengths, counts)):
            found.append((room, items))
        return len([1 for w, _ in found if w == 0]) >= most

    grow((first,), capacity - first)
    return [items for _, items in sorted(found, key=lambda f: (f[0], [-x for x in f[1]]))[:most]]


def _greedy(first: int, lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, ...]:
    """The best-fit filling around `first`: always the longest free item that fits."""
    items, room = [first], capacity - first
    at = bisect_right(lengths, min(first, room)) - 1
    while at >= 0 and room:
        x = lengths[at]
        if x <= room and counts[x] > items.count(x):
            items.append(x)
            room -= x
            at = min(at, bisect_right(lengths, room) - 1)
        else:
            at -= 1
    return tuple(items)


def pack(counts: dict[int, int], capacity: int, *, nodes: int = 8_000, most: int = 3, steps: int = 60) -> list[Filling]:
    """Fillings and how many sequences use each; every item of `counts` is placed once."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(x * n for x, n in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(n for _, n in best)
    left, lengths = dict(counts), sorted(counts)
    taken: list[Filling] = []
    waste = 0
    options: list[list[tuple[int, ...]]] = []

    def apply(items: tuple[int, ...]) -> int:
        times = min(left[x] // items.count(x) for x in set(items))
        for x in set(items):
            left[x] -= times * items.count(x)
            if not left[x]:
                del lengths[bisect_left(lengths, x)]
        taken.append((items, times))
        return times * (capacity - sum(items))

    def undo() -> int:
        items, times = taken.pop()
        for x in set(items):
            if not left[x]:
                insort(lengths, x)
            left[x] += times * items.count(x)
        return times * (capacity - sum(items))

    def branch() -> list[tuple[int, ...]]:
        first = lengths[-1]
        out = fillings(first, lengths, left, capacity, waste=capacity, most=most, steps=steps)
        quick = _greedy(first, lengths, left, capacity)
        return sorted({*out, quick}, key=lambda f: (capacity - sum(f), [-x for x in f]))

    while best_bins > bound and nodes:
        nodes -= 1
        if not lengths:
            best, best_bins = list(taken), sum(n for _, n in taken)
        elif total + waste <= (best_bins - 1) * capacity:
            options.append(branch())
            waste += apply(options[-1].pop(0))
            continue
        # a leaf, or no room for an improvement: the next option of the deepest node that has one
        while options:
            waste -= undo()
            if options[-1]:
                waste += apply(options[-1].pop(0))
                break
            options.pop()
        else:
            break
    return best
