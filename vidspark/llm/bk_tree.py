"""BK-trees over 64-bit fingerprints, many at once, as numpy arrays.

A tree holds the distinct fingerprints of one shard; a child hangs on the edge numbered by its Hamming
distance to the parent. Trees are built level by level (of all that arrive at a node over one edge the
first becomes the child, the rest move on to it), which gives the tree that one-by-one insertion gives.
A query follows only the edges within the radius of its distance to the node.
"""

from __future__ import annotations

import numpy as np

EDGES = 65


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def build(shard: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root of each entry, child by node and edge or -1). `shard` is sorted; prints differ inside a shard."""
    n = len(prints)
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(starts, np.diff(np.r_[starts, n]))
    child = np.full(n * EDGES, -1, dtype=np.int32)
    active = np.flatnonzero(root != np.arange(n))
    at = root[active]
    while active.size:
        edge = at * EDGES + distance(prints[active], prints[at])
        first, where = np.unique(edge, return_index=True)
        child[first] = active[where]
        at = child[edge].astype(np.int64)
        going = at != active
        active, at = active[going], at[going]
    return root, child


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the lowest index of its group so far) after linking a[i] with b[i]."""
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def linked(shard: np.ndarray, prints: np.ndarray, radius: int, block: int = 4096, width: int = 32_768) -> np.ndarray:
    """Lowest index of the group of each entry, groups being linked by pairs of one shard within `radius`.
    A subtree whose entries all come later than the query is not entered: each pair is met once. Queries go
    in blocks, and what is open is taken `width` (query, node) pairs at a time, deepest first, so that memory
    is bounded however little the tree prunes."""
    label = np.arange(len(prints))
    root, child = build(shard, prints)
    reach = np.arange(-radius, radius + 1)
    asked = np.flatnonzero(root != np.arange(len(prints)))  # a root has nothing before it
    for low in range(0, len(asked), block):
        query = asked[low : low + block]
        todo = [(query, root[query])]
        near_by: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        while todo:
            query, node = todo.pop()
            if query.size > width:
                todo.append((query[width:], node[width:]))
                query, node = query[:width], node[:width]
            d = distance(prints[query], prints[node])
            near = d <= radius
            if near.any():
                near_by.append((query[near], node[near]))
                held += int(near.sum())
                if held > 1_000_000:
                    label = merge(label, np.concatenate([x for x, _ in near_by]), np.concatenate([y for _, y in near_by]))
                    near_by, held = [], 0
            edge = d[:, None] + reach
            after = child[node[:, None] * EDGES + np.clip(edge, 0, EDGES - 1)]
            go = (after >= 0) & (edge >= 1) & (edge < EDGES) & (after < query[:, None])
            if go.any():
                todo.append((np.broadcast_to(query[:, None], go.shape)[go], after[go].astype(np.int64)))
        if near_by:
            label = merge(label, np.concatenate([x for x, _ in near_by]), np.concatenate([y for _, y in near_by]))
    return label
