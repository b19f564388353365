"""A multigrid of aggregated nodes as a preconditioner for graph Laplacians, over numpy arrays.

Nodes are matched with the neighbour of the heaviest link, twice a level, so that about four become one; links between
aggregates add up. A cycle smooths with the damped diagonal before and after a correction from the level above, which
is found by two steps of conjugate gradients there (one where the first is good enough). Paths, grids and road networks,
on which the diagonal alone takes as many steps as the graph is wide, so need a number of steps that hardly grows.
"""

from __future__ import annotations

import numpy as np

#: Nodes up to which a level is solved outright; weight of a smoothing step; what a first step must reach.
COARSE, DAMP, GOOD = 300, 2 / 3, 0.25
#: A level of so many nodes at most, and an edge for so many entries of its matrix, multiplies with the whole matrix.
WHOLE, FULL = 4000, 8


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of columns."""
    return np.einsum("ij,ij->j", a, b)


def _matched(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of aggregates, aggregate of each node): pairs of heavily linked nodes; nodes left over join a neighbour."""
    heavy = w * (1 + 1e-3 * np.random.default_rng(n).random(len(w)))  # breaks ties
    o = np.argsort(heavy)
    a, b = np.concatenate((u[o], v[o])), np.concatenate((v[o], u[o]))
    rank = np.tile(np.arange(len(o)), 2)
    a, b = a[(i := np.argsort(rank, kind="stable"))], b[i]  # each link both ways, from the lightest on
    group = np.full(n, -1)
    every = np.arange(n)
    for _ in range(8):
        open_ = (group[a] < 0) & (group[b] < 0)
        if not open_.any():
            break
        best = np.full(n, -1)
        best[a[open_]] = b[open_]  # the last, heaviest one stays
        mutual = every[(best >= 0) & (best[best] == every)]
        group[mutual] = np.minimum(mutual, best[mutual])
    best = np.full(n, -1)
    best[a] = b
    alone = every[(group < 0) & (best >= 0)]
    joined = group[best[alone]]
    group[alone] = np.where(joined >= 0, joined, alone)
    group = np.where(group < 0, every, group)
    names, flat = np.unique(group, return_inverse=True)
    return len(names), flat


def _lifted(count: int, group: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between aggregates."""
    a, b = group[u], group[v]
    a, b, w = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], w[a != b]
    keys, flat = np.unique(a * count + b, return_inverse=True)
    return keys // count, keys % count, np.bincount(flat, w, len(keys))


class Multigrid:
    """Called with r, gives about the solution x of L x = r, each column on its own. Weights are above 0."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.n, self.u, self.v, self.w = n, u, v, w
        degree = np.bincount(u, w, n) + np.bincount(v, w, n)
        self.damped = np.divide(DAMP, degree, out=np.zeros(n), where=degree > 0)[:, None]
        self.matrix: np.ndarray | None = None
        if n <= WHOLE and n * n <= FULL * len(u):
            self.matrix = np.diag(degree)
            np.add.at(self.matrix, (u, v), -w)
            np.add.at(self.matrix, (v, u), -w)
        self.above: Multigrid | None = None
        self.inverse: np.ndarray | None = None
        if n <= COARSE:
            lap = np.diag(degree)
            np.add.at(lap, (u, v), -w)
            np.add.at(lap, (v, u), -w)
            self.inverse = np.linalg.pinv(lap, hermitian=True)
            return
        count, group = _matched(n, u, v, w)
        links = _lifted(count, group, u, v, w)
        again, other = _matched(count, *links)
        if again < 0.9 * n:  # else nearly all nodes are apart, and the diagonal does
            self.group, self.count = other[group], again
            self.above = Multigrid(again, *_lifted(again, other, *links))

    def laplacian(self, x: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return self.matrix @ x
        out = np.empty_like(x)
        for j, column in enumerate(np.ascontiguousarray(x.T)):
            flow = self.w * (column[self.u] - column[self.v])
            out[:, j] = np.bincount(self.u, flow, self.n) - np.bincount(self.v, flow, self.n)
        return out

    def _solved(self, r: np.ndarray) -> np.ndarray:
        """Up to two steps of conjugate gradients with this level's cycle."""
        if self.inverse is not None:
            return self.inverse @ r
        p = self(r)
        ap = self.laplacian(p)
        pap = dots(p, ap)
        step = np.divide(dots(p, r), pap, out=np.zeros(len(pap)), where=pap > 0)
        x = np.where(pap > 0, step * p, p)
        left = r - step * ap
        more = (pap > 0) & (dots(left, left) > GOOD * GOOD * dots(r, r))
        if not more.any():
            return x
        p, ap, pap, left = p[:, more], ap[:, more], pap[more], left[:, more]
        q = self(left)
        q = q - dots(q, ap) / pap * p
        qaq = dots(q, self.laplacian(q))
        x[:, more] += np.divide(dots(q, left), qaq, out=np.zeros(len(qaq)), where=qaq > 0) * q
        return x

    def __call__(self, r: np.ndarray) -> np.ndarray:
        if self.inverse is not None:
            return self.inverse @ r
        x = self.damped * r
        if self.above is None:
            return x
        left = r - self.laplacian(x)
        sums = np.stack([np.bincount(self.group, column, self.count) for column in left.T], axis=1)
        x = x + self.above._solved(sums)[self.group]
        return x + self.damped * (r - self.laplacian(x))
