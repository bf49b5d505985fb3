"""Array helpers of one group's hierarchical and density clustering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def merge_tree(points: np.ndarray, dist: np.ndarray, sizes: np.ndarray, linkage: str = "ward") -> np.ndarray:
    """Merges (left, right, height, size) by rising height, from a nearest-neighbour chain over a distance matrix.

    ``sizes``: the weight of each point. Points are 0..n-1, the cluster of step s is n + s.
    """
    n = len(dist)
    if n < 2:
        return np.zeros((0, 4))
    d, w = dist.astype(float), sizes.astype(float)
    if linkage == "ward":  # distances of weighted points to start with
        d = d * np.sqrt(2 * w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
    return ordered(chain_merges(d, w, linkage), sizes)


def root_of(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def chain_merges(dist: np.ndarray, sizes: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """(a, b, height) of a nearest-neighbour chain over the linkage's own distances; a cluster is named by one of its points."""
    n, d, w = len(dist), dist.copy(), sizes.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive, chain, raw = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            x = chain[-1]
            row = d[x]
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        chain = chain[:-2]
        a, b = min(x, y), max(x, y)
        h = d[a, b]
        raw.append((a, b, h))
        if linkage == "ward":
            t = w[a] + w[b] + w
            new = np.sqrt(np.maximum(((w[a] + w) * d[a] ** 2 + (w[b] + w) * d[b] ** 2 - w * h * h) / t, 0))
        elif linkage == "average":
            new = (w[a] * d[a] + w[b] * d[b]) / (w[a] + w[b])
        elif linkage == "complete":
            new = np.maximum(d[a], d[b])
        else:
            raise ValueError(f"unknown linkage {linkage!r}")
        new[~alive] = np.inf
        new[[a, b]] = np.inf
        d[b], d[:, b] = new, new
        d[a], d[:, a] = np.inf, np.inf
        alive[a], w[b] = False, w[a] + w[b]
    return raw


def ordered(raw: list[tuple[int, int, float]], sizes: np.ndarray) -> np.ndarray:
    """``raw`` merges as (left, right, height, size) by rising height."""
    n = len(sizes)
    order = np.argsort([h for _, _, h in raw], kind="stable")
    name, weight, out = list(range(n)), sizes.astype(float).copy(), []
    root = list(range(n))
    for step, i in enumerate(order):
        a, b, h = raw[i]
        a, b = root_of(root, a), root_of(root, b)
        left, right = sorted((name[a], name[b]))
        root[a], weight[b], name[b] = b, weight[a] + weight[b], n + step
        out.append((left, right, h, weight[b]))
    return np.array(out)


def cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 0..k-1 of the tree cut into ``k`` clusters, numbered by their first point."""
    k = max(1, min(k, n))
    root = list(range(2 * n))
    for step, (a, b, _, _) in enumerate(merges[: n - k]):
        root[int(a)] = root[int(b)] = n + step
    place: dict[int, int] = {}
    return np.array([place.setdefault(root_of(root, i), len(place)) for i in range(n)], int)


def density_labels(dist: np.ndarray, weight: np.ndarray, min_size: int, min_samples: int, eps: float = 0.0) -> np.ndarray:
    """Labels of stable density clusters, -1 for noise: mutual reachability, spanning tree, condensed tree, excess of mass."""
    n = len(dist)
    if n < 2 or weight.sum() < min_size:
        return np.full(n, -1)
    order = np.sort(dist, axis=1)
    core = order[:, min(min_samples, n - 1)]
    return spanning_labels(lambda i: dist[i], core, weight, min_size, eps)


def spanning_labels(row: Callable[[int], np.ndarray], core: np.ndarray, weight: np.ndarray, min_size: int, eps: float = 0.0) -> np.ndarray:
    """``density_labels`` from the core distances and a function that gives a point's distances to all."""
    n = len(core)
    inside, best, link, edges, ids = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), [], np.arange(n)
    at = 0
    for _ in range(n - 1):  # among equal edges the smaller (a, b) first
        inside[at] = True
        reach = np.maximum(row(at), np.maximum(core[at], core))
        earlier = (np.minimum(ids, at) < np.minimum(ids, link)) | ((np.minimum(ids, at) == np.minimum(ids, link)) & (np.maximum(ids, at) < np.maximum(ids, link)))
        closer = ((reach < best) | ((reach == best) & earlier)) & ~inside
        best[closer], link[closer] = reach[closer], at
        open_ = np.where(inside, np.inf, best)
        equal = np.flatnonzero(open_ == open_.min())
        at = int(equal[np.lexsort((np.maximum(equal, link[equal]), np.minimum(equal, link[equal])))[0]])
        edges.append((best[at], min(int(link[at]), at), max(int(link[at]), at)))
    return tree_labels(sorted(edges), core, weight, min_size, eps)


def tree_labels(edges: list[tuple[float, int, int]], core: np.ndarray, weight: np.ndarray, min_size: int, eps: float = 0.0) -> np.ndarray:
    """Labels of the stable clusters of a spanning tree, its edges (w, a, b) by rising w."""
    n = len(core)
    root, node, kids, height, size = list(range(n)), list(range(n)), {}, {}, dict(enumerate(weight.astype(float)))
    for s, (h, a, b) in enumerate(edges):
        a, b = root_of(root, a), root_of(root, b)
        kids[n + s], height[n + s], size[n + s] = (node[a], node[b]), h, size[node[a]] + size[node[b]]
        root[a] = b
        node[b] = n + s
    top = n + len(edges) - 1

    def points(x: int) -> list[int]:
        out, stack = [], [x]
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += kids[y]
        return out

    lam = lambda h: 1 / max(h, 1e-12)
    born, stable, sub, tree, stack = {top: 0.0}, {}, {}, {}, [(top, top)]
    while stack:  # walk down; a node belongs to the condensed cluster ``c``
        x, c = stack.pop()
        stable.setdefault(c, 0.0)
        if x < n:
            stable[c] += weight[x] * (lam(core[x]) - born[c]) if born[c] < lam(core[x]) else 0.0
            continue
        here, big = lam(height[x]), [y for y in kids[x] if size[y] >= min_size]
        if len(big) == 2:
            stable[c] += size[x] * (here - born[c])
            sub[c] = big
            for y in big:
                born[y], tree[y] = here, c
                stack.append((y, y))
            continue
        for y in kids[x]:
            if y in big:
                stack.append((y, c))
            else:
                stable[c] += size[y] * (here - born[c])
    chosen: dict[int, bool] = {}
    score = dict(stable)
    for c in sorted(stable, reverse=True):  # children have smaller numbers than parents
        chosen[c] = True
    for c in sorted(stable):
        if c in sub:
            below = sum(score[y] for y in sub[c])
            if c == top or below > stable[c]:
                score[c], chosen[c] = max(below, stable[c]) if c != top else below, False
    final, stack = [], [top]
    while stack:
        c = stack.pop()
        if chosen[c] and c != top:
            final.append(c)
        elif c in sub:
            stack += sub[c]
    if eps > 0:  # clusters born closer than eps go up to their first ancestor that was not
        up = set()
        for c in final:
            while tree[c] != top and born[c] > 1 / eps:
                c = tree[c]
            up.add(c)
        final = [c for c in up if not any(a in up for a in _ancestors(c, tree))]
    labels = np.full(n, -1)
    for i, members in enumerate(sorted((points(c) for c in final), key=min)):
        labels[members] = i
    return labels


def _ancestors(c: int, tree: dict[int, int]) -> list[int]:
    out = []
    while c in tree:
        c = tree[c]
        out.append(c)
    return out
