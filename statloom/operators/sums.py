"""Sums of weighted distances between all pairs of many clusters, without looking at every pair of points.

Boxes far from each other, as measured by their width, see each other's points
through interpolation nodes, a cluster's weights carried over to the nodes of its box;
near ones are compared point by point. With ``NODES`` nodes a column and boxes at least
``APART`` half widths apart the sums agree with those of all pairs to about twelve
digits. Boxes with more nodes than points, and boxes of three or more columns, whose
nodes are too many, are compared point by point.
"""

from __future__ import annotations

import numpy as np

#: Points of a box that isn't halved, and pairs of nodes that are looked at together, at most.
LEAF, TOGETHER = 256, 8_000_000
#: Interpolation nodes a column, and half widths between boxes that see each other through them.
NODES, APART = 16, 3.0
_COS = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_BARYCENTRIC = (-1.0) ** np.arange(NODES) * np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def _basis(t: np.ndarray) -> np.ndarray:
    """Values at ``t`` (from -1 to 1) of the polynomials that are 1 at one node and 0 at the others."""
    d = t[:, None] - _COS
    hit = d == 0
    out = _BARYCENTRIC / np.where(hit, 1.0, d)
    out /= out.sum(axis=1, keepdims=True)
    some = hit.any(axis=1)
    out[some] = hit[some]
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all points of two sets."""
    out = np.subtract.outer(a[:, 0], b[:, 0])
    np.square(out, out=out)
    for c in range(1, a.shape[1]):
        d = np.subtract.outer(a[:, c], b[:, c])
        np.square(d, out=d)
        out += d
    return np.sqrt(out, out=out)


class Boxes:
    """Halved sets of clusters, then of a cluster's points; ``order`` has the clusters as the rows and columns of the sums have them."""

    def __init__(self, z: np.ndarray, weight: np.ndarray, start: np.ndarray, mean: np.ndarray) -> None:
        count = np.diff(np.concatenate([start, [len(z)]]))
        self.order = np.arange(len(start))
        todo, lo, hi, child = [0], [0], [len(start)], [-1]
        while todo:
            at = todo.pop()
            a, b = lo[at], hi[at]
            if b - a > 1 and count[self.order[a:b]].sum() > LEAF:
                part = mean[self.order[a:b]]
                mid = a + (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, np.ptp(part, axis=0).argmax()], mid - a)]
                child[at] = len(lo)
                todo += [len(lo), len(lo) + 1]
                lo, hi, child = lo + [a, mid], hi + [mid, b], child + [-1, -1]
        self.count = count[self.order]
        self.head = np.concatenate([[0], np.cumsum(self.count)])
        rows = np.repeat(start[self.order] - self.head[:-1], self.count) + np.arange(len(z))
        self.z, self.weight = z[rows], weight[rows]
        first, last = [int(self.head[a]) for a in lo], [int(self.head[b]) for b in hi]
        todo = [i for i in range(len(lo)) if child[i] < 0 and last[i] - first[i] > LEAF]
        while todo:
            at = todo.pop()
            a, b = first[at], last[at]
            part, mid = self.z[a:b], a + (b - a) // 2
            by = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], mid - a)
            self.z[a:b], self.weight[a:b] = part[by], self.weight[a:b][by]
            child[at] = len(lo)
            todo += [i for i, n in ((len(lo), mid - a), (len(lo) + 1, b - mid)) if n > LEAF]
            lo, hi, child = lo + [lo[at]] * 2, hi + [hi[at]] * 2, child + [-1, -1]
            first, last = first + [a, mid], last + [mid, b]
        self.lo, self.hi, self.child, self.first, self.last = lo, hi, child, first, last
        low, high = np.empty((len(lo), z.shape[1])), np.empty((len(lo), z.shape[1]))
        for i in range(len(lo) - 1, -1, -1):
            if child[i] < 0:
                part = self.z[first[i] : last[i]]
                low[i], high[i] = part.min(axis=0), part.max(axis=0)
            else:
                low[i], high[i] = np.minimum(low[child[i]], low[child[i] + 1]), np.maximum(high[child[i]], high[child[i] + 1])
        self.low, self.high = low.tolist(), high.tolist()
        self.middle, half = (low + high) / 2, (high - low) / 2
        self.half, self.widest = half, half.max(axis=1).tolist()
        self.nodes = [int(n) for n in np.where(half > 0, float(NODES), 1.0).prod(axis=1).clip(max=1e9)]
        self.seen: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}

    def parts(self, most: int) -> list[int]:
        """Boxes that hold every point once, of at most so many points (or leaves)."""
        out, todo = [], [0]
        while todo:
            i = todo.pop()
            if self.child[i] < 0 or self.last[i] - self.first[i] <= most:
                out.append(i)
            else:
                todo += [self.child[i] + 1, self.child[i]]
        return out

    def places(self, i: int) -> np.ndarray:
        """Interpolation nodes of a box."""
        if i not in self.at:
            grids = [m + h * _COS if h > 0 else np.array([m]) for m, h in zip(self.middle[i], self.half[i], strict=True)]
            self.at[i] = np.stack([g.reshape(-1) for g in np.meshgrid(*grids, indexing="ij")], axis=1)
        return self.at[i]

    def _spread(self, i: int, z: np.ndarray) -> np.ndarray:
        """Shares of points on the nodes of a box."""
        out = np.ones((len(z), 1))
        for c, (m, h) in enumerate(zip(self.middle[i], self.half[i], strict=True)):
            if h > 0:
                out = (out[:, :, None] * _basis((z[:, c] - m) / h)[:, None, :]).reshape(len(z), -1)
        return out

    def carried(self, i: int) -> np.ndarray:
        """Weights of a box's clusters on its nodes."""
        if i not in self.seen:
            child, n = self.child[i], self.hi[i] - self.lo[i]
            out = np.zeros((n, self.nodes[i]))
            if child < 0:
                share = self._spread(i, self.z[self.first[i] : self.last[i]])
                for k, a, b in self._each(i):
                    out[k] = self.weight[a:b] @ share[a - self.first[i] : b - self.first[i]]
            else:
                for c in (child, child + 1):
                    known = self.nodes[c] <= self.last[c] - self.first[c]
                    place, of = (self.places(c), self.carried(c)) if known else (self.z[self.first[c] : self.last[c]], None)
                    for k in range(0, len(place), 4096):
                        share = self._spread(i, place[k : k + 4096])
                        if known:
                            out[self.lo[c] - self.lo[i] : self.hi[c] - self.lo[i]] += of[:, k : k + 4096] @ share
                            continue
                        top = self.first[c] + k
                        for j, a, b in self._each(c):
                            a, b = max(a, top), min(b, top + len(share))
                            if a < b:
                                out[self.lo[c] - self.lo[i] + j] += self.weight[a:b] @ share[a - top : b - top]
            self.seen[i] = out
        return self.seen[i]

    def _each(self, i: int):
        """(number, first, last) of the points of each cluster in a box."""
        if self.hi[i] - self.lo[i] == 1:
            return [(0, self.first[i], self.last[i])]
        head = self.head[self.lo[i] : self.hi[i] + 1].tolist()
        return [(k, a, b) for k, (a, b) in enumerate(zip(head, head[1:], strict=False))]

    def _plain(self, i: int, j: int) -> np.ndarray:
        """Sums point by point; a box with itself: each pair once."""
        a, b = self.z[self.first[i] : self.last[i]], self.z[self.first[j] : self.last[j]]
        d = apart(a, b)
        if i == j:
            d = np.triu(d)
        d = np.stack([d[:, p - self.first[j] : q - self.first[j]] @ self.weight[p:q] for _, p, q in self._each(j)], axis=1)
        return np.stack([self.weight[p:q] @ d[p - self.first[i] : q - self.first[i]] for _, p, q in self._each(i)])

    def sums(self, i: int, others: list[int]) -> np.ndarray:
        """Sums of the clusters of box ``i`` (rows) with those of other boxes; with itself each pair of points once."""
        out = np.zeros((self.hi[i] - self.lo[i], len(self.order)))
        base, todo = self.lo[i], [(i, j) for j in others]
        while todo:
            a, b = todo.pop()
            na, nb = self.last[a] - self.first[a], self.last[b] - self.first[b]
            if a != b:
                gap = sum(max(l - v, m - h, 0.0) ** 2 for l, h, m, v in zip(self.low[a], self.high[a], self.low[b], self.high[b], strict=True)) ** 0.5
                if gap > 0 and gap >= APART * max(self.widest[a], self.widest[b]) and self.nodes[a] * self.nodes[b] <= min(na * nb, TOGETHER):
                    out[self.lo[a] - base : self.hi[a] - base, self.lo[b] : self.hi[b]] += self.carried(a) @ apart(self.places(a), self.places(b)) @ self.carried(b).T
                    continue
            if (self.child[a] < 0 and self.child[b] < 0) or na * nb <= LEAF * LEAF:
                out[self.lo[a] - base : self.hi[a] - base, self.lo[b] : self.hi[b]] += self._plain(a, b)
            elif a == b:
                c = self.child[a]
                todo += [(c, c), (c, c + 1), (c + 1, c + 1)]
            elif self.child[b] < 0 or (self.child[a] >= 0 and na >= nb):
                todo += [(self.child[a], b), (self.child[a] + 1, b)]
            else:
                todo += [(a, self.child[b]), (a, self.child[b] + 1)]
        return out
