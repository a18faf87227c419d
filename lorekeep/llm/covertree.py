"""Cover trees over unit vectors and their dual traversal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 24
LEVELS = 24
SLACK = 1e-9
"""Added to every pruning bound, so that rounding never prunes a pair at the threshold."""


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Nested levels of centres with halving radii.

    A node holds a centre, the members it covers and its covering radius, which is the largest distance from
    the centre to a member.  Its children are centres at least half the level's radius apart, the node's own
    centre first (nesting); each member goes to the first child that covers it.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.members, self.children = [], [], [], []
        if len(points):
            everyone = np.arange(len(points))
            self._grow(self._node(0, everyone, distances(points[:1], points)[0]), 1.0, 0)

    def _node(self, centre: int, members: np.ndarray, reach: np.ndarray) -> int:
        self.centre.append(centre)
        self.members.append(members)
        self.radius.append(float(reach.max()))
        self.children.append([])
        return len(self.centre) - 1

    def _grow(self, root: int, radius: float, depth: int) -> None:
        todo = [(root, radius, depth)]
        while todo:
            node, radius, depth = todo.pop()
            if len(self.members[node]) <= LEAF or depth >= LEVELS or self.radius[node] == 0:
                continue
            left, centre = self.members[node], self.centre[node]
            while len(left):
                reach = distances(self.points[centre : centre + 1], self.points[left])[0]
                reach[left == centre] = 0.0
                inside = reach <= radius
                child = self._node(centre, left[inside], reach[inside])
                self.children[node].append(child)
                todo.append((child, radius / 2, depth + 1))
                left = left[~inside]
                centre = left[0] if len(left) else -1


def near_pairs(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that may be within ``reach``; every pair that is, is among them exactly once.

    Node pairs are visited from the roots down and dropped when their centres are further apart than
    ``reach`` and both covering radii together.
    """
    if not len(a.points) or not len(b.points):
        return
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        left, right = a.children[i], b.children[j]
        if not left and not right:
            x, y = a.members[i], b.members[j]
            for at in range(0, len(x), 1024):
                hit = np.nonzero(distances(a.points[x[at : at + 1024]], b.points[y]) <= reach + SLACK)
                if len(hit[0]):
                    yield x[at + hit[0]], y[hit[1]]
            continue
        left, right = np.array(left or [i]), np.array(right or [j])  # a leaf waits while the other side goes down
        ra, rb = np.array(a.radius)[left], np.array(b.radius)[right]
        apart = distances(a.points[np.array(a.centre)[left]], b.points[np.array(b.centre)[right]])
        near = apart <= ra[:, None] + rb[None, :] + reach + SLACK
        sizes_a = np.array([len(a.members[k]) for k in left])
        sizes_b = np.array([len(b.members[k]) for k in right])
        single = near & (sizes_a == 1)[:, None] & (sizes_b == 1)[None, :]
        p, q = np.nonzero(single)
        if len(p):
            yield np.array(a.centre)[left[p]], np.array(b.centre)[right[q]]
        p, q = np.nonzero(near & ~single)
        todo += zip(left[p].tolist(), right[q].tolist())
