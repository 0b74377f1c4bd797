"""Spanning forests of near fingerprints from BK-trees, nearest links first.

The trees of `bk_tree` are asked with a growing radius. What an earlier, narrower pass has linked is one group,
and a subtree that holds only the query's own group is not entered again; so in a crowd of near copies the wide
pass has next to nothing left to do. The links of all passes are a minimum spanning forest by Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from vidspark.llm.bk_tree import EDGES, build, distance


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, places of the pairs kept): groups joined by pairs in order of `d`, one pair for each join.
    A label is the lowest index of its group."""
    label, kept = label.copy(), []
    for k in np.unique(d):
        here = np.flatnonzero(d == k)
        while here.size:
            x, y = label[a[here]], label[b[here]]
            apart = x != y
            here, x, y = here[apart], x[apart], y[apart]
            if not here.size:
                break
            high, first = np.unique(np.maximum(x, y), return_index=True)
            kept.append(here[first])
            label[high] = np.minimum(x, y)[first]
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label, np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)


def _levels(root: np.ndarray, child: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(parents, children) of every level, top level first."""
    place = np.flatnonzero(child >= 0)
    parent = root.copy()
    parent[child[place]] = place // EDGES
    depth, at = np.zeros(len(root), dtype=np.int64), np.arange(len(root))
    while True:
        moving = at != root
        if not moving.any():
            break
        depth += moving
        at = parent[at]
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    return [(parent[x], x) for x in np.split(order, cuts)[1:]]


def _one_group(label: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The label of all entries of each subtree, or -1 where they differ."""
    low, high = label.copy(), label.copy()
    for parent, node in reversed(levels):
        np.minimum.at(low, parent, low[node])
        np.maximum.at(high, parent, high[node])
    return np.where(low == high, low, -1)


def _near(prints: np.ndarray, root: np.ndarray, child: np.ndarray, label: np.ndarray, whole: np.ndarray, radius: int, block: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, node, distance) of entries of different groups within the radius; each pair is met once, from
    its later entry. What is open is taken `width` at a time, deepest first, so memory is bounded."""
    reach = np.arange(-radius, radius + 1)
    asked = np.flatnonzero((root != np.arange(len(prints))) & (whole[root] != label))
    for low in range(0, len(asked), block):
        query = asked[low : low + block]
        todo = [(query, root[query])]
        while todo:
            query, node = todo.pop()
            if query.size > width:
                todo.append((query[width:], node[width:]))
                query, node = query[:width], node[:width]
            d = distance(prints[query], prints[node])
            near = (d <= radius) & (label[query] != label[node])
            if near.any():
                yield query[near], node[near], d[near]
            edge = d[:, None] + reach
            after = child[node[:, None] * EDGES + np.clip(edge, 0, EDGES - 1)]
            go = (after >= 0) & (edge >= 1) & (edge < EDGES) & (after < query[:, None])
            at, k = np.nonzero(go)
            after = after[at, k].astype(np.int64)
            open_ = whole[after] != label[query[at]]
            if open_.any():
                todo.append((query[at][open_], after[open_]))


def forest(shard: np.ndarray, prints: np.ndarray, radius: int, *, block: int = 4096, width: int = 32_768, held: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that link all entries of one shard within `radius` of each other, the nearest first.
    `shard` is sorted; prints differ inside a shard."""
    root, child = build(shard, prints)
    levels = _levels(root, child)
    label = np.arange(len(prints))
    out_a, out_b = [], []
    for reach in sorted({radius // 4, radius // 2, radius}):
        whole = _one_group(label, levels)
        found: list[tuple[np.ndarray, ...]] = []
        size = 0
        for pairs in _near(prints, root, child, label, whole, reach, block, width):
            found.append(pairs)
            size += len(pairs[0])
            if size > held:  # only what a forest of the pairs so far needs
                a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
                _, kept = spanning(label, a, b, d)
                found, size = [(a[kept], b[kept], d[kept])], 0
        if found:
            a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
            label, kept = spanning(label, a, b, d)
            out_a.append(a[kept])
            out_b.append(b[kept])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
