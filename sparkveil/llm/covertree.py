"""Cover trees over integer points, built in one block and walked level by level.

A node stands for a set of points around one of them: children lie within their parent's radius
bound, siblings are further apart than half of it, and a node with few points or no extent is a
leaf. Each node carries the sum and the number of its points, so a subtree that is nearest to one
entry as a whole is counted without its points being looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A node with so many points or fewer is not divided.
LEAF = 24


@dataclass
class CoverTree:
    """Nodes in order of level. Points of a node stand together in `order`: first[k] up to last[k];
    its children, if any, are nodes child[k] up to child[k] + children[k]."""

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    children: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        """Of n points (n, dims) as 64-bit integers."""
        n = len(points)
        order = np.arange(n)
        as_float = points.astype(np.float64)
        centre, first, last, child, children, radius = [], [], [], [], [], []

        def node(at: int, to: int, of: int) -> None:
            centre.append(of)
            first.append(at)
            last.append(to)
            child.append(0)
            children.append(0)
            gap = as_float[order[at:to]] - as_float[of]
            # rounded up, so that the bound holds in floating point
            radius.append(float(np.sqrt((gap * gap).sum(axis=1).max())) * (1 + 1e-9) if to > at else 0.0)

        if n:
            node(0, n, 0)
        at = 0
        while at < len(centre):
            low, high = first[at], last[at]
            if high - low > LEAF and radius[at] > 0:
                child[at] = len(centre)
                limit = (radius[at] / 2) ** 2
                rest, done, of = order[low:high].copy(), low, centre[at]
                while len(rest):
                    gap = as_float[rest] - as_float[of]
                    near = (gap * gap).sum(axis=1) <= limit
                    own = rest[near]
                    order[done : done + len(own)] = own
                    node(done, done + len(own), of)
                    done += len(own)
                    rest = rest[~near]
                    of = int(rest[0]) if len(rest) else of
                children[at] = len(centre) - child[at]
            at += 1
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
        first_, last_ = np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)
        return cls(points, order, np.array(centre, dtype=np.int64), np.array(radius), first_, last_, np.array(child, dtype=np.int64), np.array(children, dtype=np.int64), sums[last_] - sums[first_])

    def assign(self, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Who goes to which entry: ([(nodes, their entry)], entry of each point left over, -1 elsewhere).

        A whole subtree goes to an entry that beats every other by more than the node's diameter.
        Ties and what the bound cannot decide are compared exactly, in integers, at the leaves.
        """
        whole, single = [], np.full(len(self.points), -1, dtype=np.int64)
        level = np.arange(min(1, len(self.centre)))
        place = entries.astype(np.float64)
        while len(level):
            gap = self.points[self.centre[level]].astype(np.float64)[:, None, :] - place[None]
            distance = np.sqrt((gap * gap).sum(axis=2))
            best = distance.argmin(axis=1)
            rows = np.arange(len(level))
            nearest = distance[rows, best]
            distance[rows, best] = np.inf
            second = distance.min(axis=1) if len(entries) > 1 else np.full(len(level), np.inf)
            # the margin covers the rounding of both distances
            clear = second - nearest > 2 * self.radius[level] + 1e-9 * (nearest + self.radius[level]) + 1e-6
            whole.append((level[clear], best[clear]))
            level = level[~clear]
            ends = self.children[level] == 0
            for k in level[ends]:
                own = self.order[self.first[k] : self.last[k]]
                single[own] = -2
            inner = level[~ends]
            counts = self.children[inner]
            level = np.repeat(self.child[inner] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(inner) else inner
        open_ = np.flatnonzero(single == -2)
        for low in range(0, len(open_), 4096):
            some = open_[low : low + 4096]
            single[some] = squared(self.points[some], entries).argmin(axis=1)
        return whole, single

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points of each entry."""
        count, total = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=np.int64)
        whole, single = self.assign(entries)
        for nodes, entry in whole:
            np.add.at(count, entry, self.last[nodes] - self.first[nodes])
            np.add.at(total, entry, self.total[nodes])
        left = single >= 0
        np.add.at(count, single[left], 1)
        np.add.at(total, single[left], self.points[left])
        return count, total

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The entry of each point."""
        whole, single = self.assign(entries)
        for nodes, entry in whole:
            for k, e in zip(nodes, entry, strict=True):
                single[self.order[self.first[k] : self.last[k]]] = e
        return single


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (points, entries)."""
    gap = points[:, None, :] - entries[None]
    return (gap * gap).sum(axis=2)
