"""A multiway hyperplane tree with distance ranges between siblings, in the manner of GNAT.

Inner products become distances by one more coordinate: with M the largest norm of the indexed vectors, x gets
sqrt(M^2 - |x|^2) and a query gets 0, so that distance^2 = |query|^2 + M^2 - 2 * score. A window of scores is then an annulus
around the query.

The tree is fitted on a bounded sample: in each of two levels, far-apart sample vectors become split points, and a vector goes
to the nearest one, that is, to its side of the hyperplanes between them. Every vector is indexed; for each split point i and
each sibling j the tree keeps the least and the greatest distance from i to any vector below j. A query at distance d from i
can have a vector of j within its annulus [r, R] only if [max(d - high, low - d), d + high] meets it; a sibling that any split
point rules out is never visited. What lies in a leaf is compared exactly by the caller.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

SAMPLE = 4096
WAYS = 16
SLACK = 1e-7


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with their further coordinate; most is the largest squared norm of all."""
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def far_apart(sample: np.ndarray, ways: int) -> np.ndarray:
    """Up to so many different vectors of a sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    away = distances(sample, sample[:1])[:, 0]
    while len(chosen) < ways and away.max() > SLACK * (1 + np.abs(sample).max()):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class Tree:
    """Split points of the root and of each of its children; leaves are numbered child * WAYS + place in it."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most = most
        sample = lifted(sample, most)
        self.points = [far_apart(sample, WAYS)]
        nearest = distances(sample, self.points[0]).argmin(axis=1) if len(sample) else np.empty(0, int)
        for j in range(len(self.points[0])):
            self.points.append(far_apart(sample[nearest == j], WAYS))
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]

    def place(self, v: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float, float]]]:
        """Leaf of each vector, and (node, i, j, least, greatest) distances from split points i to those below j."""
        x = lifted(v, self.most)
        leaf, ranges = np.zeros(len(x), np.int64), []

        def split(node: int, at: np.ndarray) -> np.ndarray:
            d = distances(x[at], self.points[node])
            side = d.argmin(axis=1)
            for j in np.unique(side):
                low, high = d[side == j].min(axis=0), d[side == j].max(axis=0)
                ranges.extend((node, i, int(j), float(low[i]), float(high[i])) for i in range(len(low)))
            return side
        child = split(0, np.arange(len(x))) if len(x) else leaf
        for j in np.unique(child):
            at = np.nonzero(child == j)[0]
            leaf[at] = j * WAYS + split(1 + int(j), at)
        return leaf, ranges

    def learn(self, ranges: Iterable[tuple[int, int, int, float, float]]) -> None:
        """Take the ranges of all vectors; there are at most (WAYS + 1) * WAYS * WAYS of them."""
        for node, i, j, low, high in ranges:
            self.low[node][i, j] = min(self.low[node][i, j], low)
            self.high[node][i, j] = max(self.high[node][i, j], high)

    def reach(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and leaf, the least and the greatest distance that a vector there can have; least > greatest where empty."""
        q = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1)
        low, high = np.full((len(q), WAYS * WAYS), np.inf), np.full((len(q), WAYS * WAYS), -np.inf)

        def bounds(node: int) -> tuple[np.ndarray, np.ndarray]:
            d = distances(q, self.points[node])[:, :, None]
            near = np.maximum(d - self.high[node][None], self.low[node][None] - d).max(axis=1)
            return near, (d + self.high[node][None]).min(axis=1)
        if len(self.points[0]):
            near, far = bounds(0)
            for j in range(near.shape[1]):
                if len(self.points[1 + j]):
                    a, b = bounds(1 + j)
                    at = slice(j * WAYS, j * WAYS + a.shape[1])
                    low[:, at], high[:, at] = np.maximum(a, near[:, j:j + 1]), np.minimum(b, far[:, j:j + 1])
        return low, high

    def annulus(self, square: np.ndarray, least: np.ndarray, greatest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances between which scores from least to greatest lie, for queries of these squared norms."""
        square = square + self.most
        slack = SLACK * (1 + square)
        far = np.sqrt(np.maximum(square - 2 * least.astype(np.float64) + slack, 0))
        if greatest is None:
            return np.zeros_like(far), far
        return np.sqrt(np.maximum(square - 2 * greatest.astype(np.float64) - slack, 0)), far

    def visits(self, near: np.ndarray, far: np.ndarray, annulus: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Per query, whether its annulus meets the distances that vectors of a leaf can have."""
        slack = SLACK * (1 + np.sqrt(self.most) + np.abs(np.where(np.isfinite(near), near, 0)))
        return (near - slack <= annulus[1]) & (far + slack >= annulus[0])
