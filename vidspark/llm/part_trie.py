"""Nearest codebook entries of many distinct parts, through their trie.

Parts sorted by their components form a trie: a node is a prefix, and the squared distances of a prefix to
all entries, one number per entry, are those of its parent plus one more component. The traversal goes depth
first with a stack of nodes; below a node with few parts the remaining levels are taken together, still one
row of distances per distinct prefix. Leaves take the lowest distance, of equal ones the lowest index.
"""

from __future__ import annotations

import numpy as np

#: Parts below a node whose levels are taken together: bounds the memory at so many rows of distances.
TOGETHER = 2048


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance of every part; `parts` are distinct, whole numbers,
    in lexicographic order."""
    n, width = parts.shape
    chosen, error = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    fresh = np.ones((n, width), dtype=bool)  # a row begins a prefix of this length
    if n > 1:
        fresh[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)

    def grown(above: np.ndarray, heads: np.ndarray, depth: int) -> np.ndarray:
        step = parts[heads, depth][:, None] - entries[:, depth]
        return above + step * step

    stack = [(0, n, 0, np.zeros(len(entries), dtype=np.int64))] if n else []
    while stack:
        low, high, depth, above = stack.pop()
        if high - low <= TOGETHER:
            heads = low + np.flatnonzero(fresh[low:high, depth])
            reach = grown(above, heads, depth)
            for level in range(depth + 1, width):
                children = low + np.flatnonzero(fresh[low:high, level])
                reach = grown(reach[np.searchsorted(heads, children, side="right") - 1], children, level)
                heads = children
            chosen[low:high] = reach.argmin(axis=1)
            error[low:high] = reach.min(axis=1)
            continue
        heads = low + np.flatnonzero(fresh[low:high, depth])
        ends = [*heads[1:].tolist(), high]
        for head, end in zip(heads.tolist(), ends, strict=True):  # more than TOGETHER parts lie below, so not the last level
            stack.append((head, end, depth + 1, grown(above, np.array([head]), depth)[0]))
    return chosen, error


def nearest_of_any(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for parts in any order, repeats included."""
    if not len(parts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    order = np.lexsort(parts.T[::-1])
    laid = parts[order]
    new = np.concatenate([[True], (laid[1:] != laid[:-1]).any(axis=1)])
    chosen, error = nearest(laid[new], entries)
    at = np.empty(len(parts), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return chosen[at], error[at]
