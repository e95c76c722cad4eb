"""A packed R-tree over points of group counts."""

from __future__ import annotations

import numpy as np

LEAF = 128


class RTree:
    """Points ``counts`` (rows of group counts) of sets with ``sizes`` elements.

    Built once by splitting at the median of the widest coordinate until at
    most ``LEAF`` points are left; the points of a node lie side by side. Sets
    that have ``o`` elements in common have points whose coordinate minima sum to ``o``
    or more, so a node is left out when the minima of the query and the node's
    upper corner sum to less than the least overlap that a similar set of its sizes needs.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.rows = np.arange(len(sizes))
        self.counts = np.ascontiguousarray(counts, np.int32)
        self.sizes = sizes.astype(np.int64)
        self.nodes: list[tuple] = []
        self._build(0, len(sizes))
        self.place = np.argsort(self.rows)  # where each row lies

    def _build(self, a: int, b: int) -> None:
        at = len(self.nodes)
        own = self.counts[a:b]
        top, sizes = own.max(0), self.sizes[a:b]
        self.nodes.append(())
        middle = 0
        if b - a > LEAF:
            wide = int(np.argmax(top - own.min(0)))
            order = np.argsort(own[:, wide], kind="stable")
            for array in (self.rows, self.counts, self.sizes):
                array[a:b] = array[a:b][order]
            middle = a + (b - a) // 2
        self.nodes[at] = (top, int(sizes.min()), int(sizes.max()), a, b, at + 1 if middle else 0)
        if middle:
            self._build(a, middle)
            other = len(self.nodes)
            self._build(middle, b)
            self.nodes[at] = (*self.nodes[at][:5], (at + 1, other))

    def _near(self, x: int, wanted: np.ndarray | None) -> np.ndarray:
        """Places whose bound allows ``den * overlap >= num * union`` with the set at place ``x``."""
        num, den, counts, size = self.num, self.den, self.counts[x], int(self.sizes[x])
        found, open_nodes = [], [0]
        while open_nodes:
            top, small, large, a, b, children = self.nodes[open_nodes.pop()]
            if num * small > den * size or num * size > den * large:
                continue
            if wanted is not None and not wanted[a:b].any():
                continue
            if children:
                # o / (x + y - o) >= num / den needs (num + den) * o >= num * (x + y)
                least = int(np.minimum(counts, top).sum())
                if (num + den) * least >= num * (size + small):
                    open_nodes += children
                continue
            overlap = np.minimum(self.counts[a:b], counts).sum(1, dtype=np.int32).astype(np.int64)
            near = (num + den) * overlap >= num * (size + self.sizes[a:b])
            if wanted is not None:
                near &= wanted[a:b]
            found.append(a + np.flatnonzero(near))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def near(self, row: int) -> np.ndarray:
        """Rows that may be similar to ``row``, itself among them."""
        return np.sort(self.rows[self._near(int(self.place[row]), None)])

    def forest(self) -> list[tuple[int, int]]:
        """A spanning forest of the pairs that the bound allows."""
        left, edges = np.ones(len(self.sizes), bool), []
        rows = self.rows.tolist()
        for start in range(len(rows)):
            if not left[start]:
                continue
            left[start], queue = False, [start]
            while queue and left.any():
                x = queue.pop()
                more = self._near(x, left)
                left[more] = False
                edges += [(rows[x], rows[y]) for y in more.tolist()]
                queue += more.tolist()
        return edges
