"""Hierarchies of many points in little memory: clusters as mean vectors, each with a list of its nearest others.

Ward distances follow from means and sizes, and average cosine distances from the means of unit vectors, so a cluster is one
vector, however many points it has. It keeps a list of its nearest clusters, and a bound that none outside the list is below. Two
that are nearest to each other by their lists, within their bounds, merge: the new cluster takes both lists, the lists of
others name it in place of the two, and distances are made anew from the means. No bound is broken, as under both linkages a new
cluster is as far from any third as the nearer of its parts at least. When lists settle no more merges, the clusters whose lists have run out
are searched again, against all that are left. Copies of a vector merge first, at distance 0.

Other distances of clusters (``point_merges``) are sums or maxima over pairs of points. They are made tile by tile, for clusters
that are new or whose nearest was merged, until all that are left fit a matrix.
"""

from __future__ import annotations

import numpy as np

from .distance import matrix
from .trees import chain_merges, merge_tree, ordered, spanning_labels

#: Length of a list; clusters searched together, and those that they meet at once; rounding of squared distances, against a vector's square.
LISTED, ROWS, COLUMNS, ROUNDING = 16, 512, 4096, 1e-12
#: Points whose distances are made at once, and those that they meet; clusters that get a matrix.
PAIR_ROWS, PAIR_COLUMNS, MATRIX = 256, 1024, 3000


def by_means(linkage: str, metric: str) -> bool:
    """Whether a cluster's distances follow from its mean and size."""
    return (linkage, metric) in (("ward", "euclidean"), ("average", "cosine"))


def start(x: np.ndarray, metric: str) -> np.ndarray:
    """The vectors whose means stand for clusters."""
    if metric != "cosine":
        return x - x.mean(0)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def gaps(x: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared Ward heights, or average cosine distances, of clusters ``a`` and ``b``; the same both ways round."""
    out = np.empty(len(a))
    for at in range(0, len(a), 20_000):
        p, q = a[at : at + 20_000], b[at : at + 20_000]
        if metric == "cosine":
            out[at : at + 20_000] = np.maximum(1 - np.einsum("ij,ij->i", x[p], x[q]), 0)
        else:
            out[at : at + 20_000] = 2 * w[p] * w[q] / (w[p] + w[q]) * ((x[p] - x[q]) ** 2).sum(1)
    return out


class Search:
    """The nearest ``LISTED`` clusters of some, while all others stream by."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, w: np.ndarray, metric: str):
        self.ids, self.part, self.metric = ids, 0.5 / w, metric
        self.x = -x if metric == "cosine" else np.column_stack([-2 * x, (x * x).sum(1), np.ones(len(x))])
        self.held = np.empty((2, ROWS * COLUMNS))
        self.near, self.gap = np.full((len(ids), LISTED), -1), np.full((len(ids), LISTED), np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
        other, part = x if self.metric == "cosine" else np.column_stack([x, np.ones(len(x)), (x * x).sum(1)]), 0.5 / w
        for q in (slice(k, k + COLUMNS) for k in range(0, len(ids), COLUMNS)):
            for p in (slice(k, k + ROWS) for k in range(0, len(self.ids), ROWS)):
                shape = len(self.ids[p]), len(ids[q])
                d, sums = (h[: shape[0] * shape[1]].reshape(shape) for h in self.held)
                np.matmul(self.x[p], other[q].T, out=d)
                if self.metric == "cosine":
                    d += 1
                else:  # 2 a b / (a + b) is 1 / (1 / 2a + 1 / 2b)
                    np.divide(d, np.add(self.part[p][:, None], part[q][None, :], out=sums), out=d)
                self._take(p, ids[q], d)

    def _take(self, p: slice, ids: np.ndarray, d: np.ndarray) -> None:
        near, gap, mine = self.near[p], self.gap[p], self.ids[p]
        if np.isinf(gap[:, -1]).any() and len(ids) > 2 * LISTED:  # so many may be nearer that each row has its smallest picked
            c = np.argpartition(d, LISTED + 1, axis=1)[:, : LISTED + 1].ravel()
            r = np.repeat(np.arange(len(mine)), LISTED + 1)
        else:
            r, c = np.divmod(np.flatnonzero((d < gap[:, -1:]).ravel()), d.shape[1])
        other = ids[c] != mine[r]
        r, c = r[other], c[other]
        if not len(r):
            return
        row, to, g = (np.concatenate(p) for p in ((np.repeat(np.arange(len(mine)), LISTED), r), (near.ravel(), ids[c]), (gap.ravel(), d[r, c])))
        order = np.lexsort((to, g, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(mine)))[row]
        first = order[place < LISTED]
        near[:], gap[:] = to[first].reshape(near.shape), g[first].reshape(gap.shape)


class Clusters:
    """What is known of the clusters that are left, in order of their names; ``near`` has places of clusters."""

    def __init__(self, names: np.ndarray, x: np.ndarray, w: np.ndarray, metric: str):
        n = len(names)
        self.names, self.x, self.w, self.metric = names, x, w, metric
        self.near, self.gap, self.bound = np.full((n, LISTED), -1), np.full((n, LISTED), np.inf), np.full(n, -np.inf)
        self.last, self.top, self.merged = np.full(n, -1), np.zeros(n), []

    def listed(self, at: np.ndarray, near: np.ndarray, gap: np.ndarray) -> None:
        """The lists of the clusters ``at``, new from a search; ``near`` has places."""
        some = near >= 0
        slack = ROUNDING * (1 if self.metric == "cosine" else 2 * self.w[at] * (self.x[at] ** 2).sum(1))
        self.bound[at] = np.where(some.all(1), np.where(some, gap, 0)[:, -1] * (1 - ROUNDING) - slack, np.inf)
        row, col = np.nonzero(some)
        gap = gap.copy()
        gap[row, col] = gaps(self.x, self.w, at[row], near[row, col], self.metric)
        self.near[at], self.gap[at] = near, gap

    def stale(self) -> np.ndarray:
        return np.flatnonzero(self.gap.min(1, initial=np.inf) > self.bound)

    def search(self) -> None:
        """Lists anew for all clusters whose lists have run out."""
        at, every = self.stale(), np.arange(len(self.names))
        found = Search(at, self.x[at], self.w[at], self.metric)
        found.meet(every, self.x, self.w)
        self.listed(at, found.near, found.gap)

    def settle(self, seq: int) -> int:
        """All merges that the lists settle after a search, in ``merged`` as arrays (seq, a, b, h, size, left, right). The next free seq."""
        began = seq
        while len(self.names) > 1:
            every = np.arange(len(self.names))
            best = self.gap.argmin(1)
            near, gap = self.near[every, best], self.gap[every, best]
            sure = (gap <= self.bound) & (near >= 0)
            if seq == began and not (sure & sure[near] & (near[near] == every)).any():
                sure = near >= 0  # distances that differ by less than rounding: the lists were just made
            back = np.where(sure, near, 0)
            a = np.flatnonzero(sure & sure[back] & (near[back] == every) & (every < back))
            if not len(a):
                if not sure.all():
                    break
                a = np.array([np.lexsort((near, gap))[0]])  # equal distances in a ring
            b = near[a]
            seq = self._merge(a, b, gap[a], seq)
        return seq

    def finish(self, seq: int) -> None:
        while len(self.names) > 1:
            self.search()
            seq = self.settle(seq)

    def _merge(self, a: np.ndarray, b: np.ndarray, gap: np.ndarray, seq: int) -> int:
        n, wa, wb = len(self.names), self.w[a], self.w[b]
        h = np.maximum(gap if self.metric == "cosine" else np.sqrt(np.maximum(gap, 0)), np.maximum(self.top[a], self.top[b]))
        named = seq + np.arange(len(a))
        self.merged.append((named, self.names[a], self.names[b], h, wa + wb, self.last[a], self.last[b]))
        self.x[b] = (self.x[a] * wa[:, None] + self.x[b] * wb[:, None]) / (wa + wb)[:, None]
        self.w[b], self.top[b], self.last[b] = wa + wb, h, named
        up, new = np.arange(n), np.zeros(n, bool)
        up[a], new[b] = b, True
        both, bound = np.concatenate([self.near[a], self.near[b]], axis=1), np.minimum(self.bound[a], self.bound[b])
        near, gap = self._anew(b, both, np.zeros(both.shape), np.ones(both.shape, bool), up)
        order = np.argsort(gap, axis=1, kind="stable")
        near, gap = np.take_along_axis(near, order, 1), np.take_along_axis(gap, order, 1)
        self.near[b], self.gap[b], self.bound[b] = near[:, :LISTED], gap[:, :LISTED], np.minimum(bound, gap[:, LISTED])  # those left out are beyond the bound
        named = new[up[self.near]] & (self.near >= 0)
        some = named.any(1)
        some[a] = some[b] = False
        at = np.flatnonzero(some)
        self.near[at], self.gap[at] = self._anew(at, self.near[at], self.gap[at], named[at], up)
        alive = np.ones(n, bool)
        alive[a] = False
        place = np.cumsum(alive) - 1
        for k in ("names", "x", "w", "near", "gap", "bound", "last", "top"):
            setattr(self, k, getattr(self, k)[alive])
        self.near = np.where(self.near >= 0, place[self.near], -1)
        return seq + len(a)

    def _anew(self, at: np.ndarray, near: np.ndarray, gap: np.ndarray, change: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of the clusters ``at`` that name merged clusters, each once, with distances anew where they ``change``."""
        near = np.where(near >= 0, up[near], -1)
        near[near == at[:, None]] = -1
        order = np.argsort(near, axis=1, kind="stable")
        near, gap, change = (np.take_along_axis(x, order, 1) for x in (near, gap, change))
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        row, col = np.nonzero(change & (near >= 0))
        gap[row, col] = gaps(self.x, self.w, at[row], near[row, col], self.metric)
        gap[near < 0] = np.inf
        return near, gap


def copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the copies of each point, and the points that are first."""
    _, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
    return first[of.ravel()], np.sort(first)


def list_merges(x: np.ndarray, sizes: np.ndarray, metric: str) -> list[tuple[int, int, float]]:
    """(a, b, height) by Ward, or by average cosine distances, as ``trees.chain_merges`` gives them."""
    rep, first = copies(x)
    raw = [(i, int(r), 0.0) for i, r in enumerate(rep.tolist()) if i != r]
    have = Clusters(first, start(x, metric)[first], np.bincount(rep, sizes, len(x))[first], metric)
    have.finish(0)
    return raw + [(int(a), int(b), float(h)) for _, p, q, g, *_ in have.merged for a, b, h in zip(p, q, g, strict=True)]


def _pair_sums(x: np.ndarray, w: np.ndarray, begins: np.ndarray, some: np.ndarray, linkage: str, metric: str) -> np.ndarray:
    """Sums (or maxima) of the distances of clusters ``some`` to all; ``x`` is sorted by cluster, ``begins`` are their first points."""
    op, ends = np.maximum if linkage == "complete" else np.add, np.append(begins[1:], len(x))
    out, even = np.zeros((len(some), len(begins))), linkage == "complete" or (w == 1).all()
    rows = np.concatenate([np.arange(begins[c], ends[c]) for c in some])
    of = np.repeat(np.arange(len(some)), ends[some] - begins[some])
    every = np.repeat(np.arange(len(begins)), ends - begins)
    for at in range(0, len(rows), PAIR_ROWS):
        p, to = rows[at : at + PAIR_ROWS], of[at : at + PAIR_ROWS]
        here, first = np.unique(to, return_index=True)
        for q in (slice(k, k + PAIR_COLUMNS) for k in range(0, len(x), PAIR_COLUMNS)):
            d = matrix(x[q], x[p], metric)  # whole rows are added up, so those of the longer side
            np.maximum(d, 0, out=d)
            if not even:
                d *= w[q][:, None] * w[p][None, :]
            there, begin = np.unique(every[q], return_index=True)
            d = (op.reduceat(d, begin, axis=0) if len(begin) < len(d) else d).T
            d = op.reduceat(d, first, axis=0) if len(here) < len(to) else d
            part = out[here[0] : here[-1] + 1, there[0] : there[-1] + 1]
            op(part, d, out=part)
    return out


def point_merges(x: np.ndarray, sizes: np.ndarray, linkage: str, metric: str, cap: int) -> list[tuple[int, int, float]]:
    """(a, b, height) by average or complete linkage over distances of points; the last ``cap`` clusters go by a matrix."""
    rep, first = copies(x)
    raw = [(i, int(r), 0.0) for i, r in enumerate(rep.tolist()) if i != r]
    names, x, w, size = first, x[first], np.bincount(rep, sizes, len(x))[first], np.bincount(rep, sizes, len(x))[first]
    begins = np.arange(len(x))  # points stay sorted by cluster
    near, gap, top = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
    while len(names) > max(2, cap):
        for some in np.array_split(stale := np.flatnonzero(near < 0), max(1, -(-len(stale) // PAIR_ROWS))):
            d = _pair_sums(x, w, begins, some, linkage, metric)
            d = d if linkage == "complete" else d / (size[some][:, None] * size[None, :])
            d[np.arange(len(some)), some] = np.inf
            near[some] = d.argmin(1)
            gap[some] = d[np.arange(len(some)), near[some]]
        every = np.arange(len(names))
        a = np.flatnonzero((near[near] == every) & (every < near))
        a = a if len(a) else np.array([np.lexsort((near, gap))[0]])  # equal distances in a ring
        b = near[a]
        h = np.maximum(gap[a], np.maximum(top[a], top[b]))
        raw += zip(names[a].tolist(), names[b].tolist(), h.tolist(), strict=True)
        size[b], top[b] = size[a] + size[b], h
        into, gone = every.copy(), np.zeros(len(names), bool)
        into[a], gone[a] = b, True
        touched = gone.copy()
        touched[b] = True
        near[touched | touched[near]] = -1
        place = np.cumsum(~gone) - 1
        of = place[into[np.repeat(every, np.diff(np.append(begins, len(x))))]]
        order = np.argsort(of, kind="stable")
        x, w, begins = x[order], w[order], np.searchsorted(of[order], np.arange(len(names) - len(a)))
        names, near, gap, top, size = (v[~gone] for v in (names, near, gap, top, size))
        near = np.where(near >= 0, place[near], -1)
    d = np.empty((len(names), len(names)))
    for some in np.array_split(np.arange(len(names)), max(1, -(-len(names) // PAIR_ROWS))):
        part = _pair_sums(x, w, begins, some, linkage, metric)
        d[some] = part if linkage == "complete" else part / (size[some][:, None] * size[None, :])
    d += d.T
    d /= 2
    return raw + [(int(names[a]), int(names[b]), h) for a, b, h in chain_merges(d, size, linkage)]


def tree_of(x: np.ndarray, sizes: np.ndarray, linkage: str, metric: str, cap: int) -> np.ndarray:
    """``trees.merge_tree`` of points, of which no more than ``cap`` have a matrix of distances."""
    if len(x) <= min(cap, MATRIX):
        return merge_tree(x, matrix(x, x, metric), sizes, linkage)
    return ordered(list_merges(x, sizes, metric) if by_means(linkage, metric) else point_merges(x, sizes, linkage, metric, min(cap, MATRIX)), sizes)


def density_rows(x: np.ndarray, weight: np.ndarray, min_size: int, min_samples: int, eps: float, metric: str) -> np.ndarray:
    """``trees.density_labels`` of points, whose distances are made row by row and not kept."""
    n, near = len(x), min(min_samples, len(x) - 1)
    if n < 2 or weight.sum() < min_size:
        return np.full(n, -1)
    x = start(x, metric)
    square = (x * x).sum(1)

    def some(p: slice | int) -> np.ndarray:
        dots = x @ x[p].T
        if metric == "cosine":
            return np.maximum(1 - dots, 0)
        return np.sqrt(np.maximum(square[p] + (square[:, None] if dots.ndim > 1 else square) - 2 * dots, 0))

    core = np.empty(n)
    for at in range(0, n, PAIR_ROWS):
        core[at : at + PAIR_ROWS] = np.partition(some(slice(at, at + PAIR_ROWS)), near, axis=0)[near]
    return spanning_labels(some, core, weight, min_size, eps)
