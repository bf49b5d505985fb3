"""All-pairs distances on a grid: sums per point and cluster, never a row per pair.

Points of a group are dealt over bands by hash, and each pair of bands is a task: one band stays, the other streams by, a
matrix product a batch, and distances are added up by point, label set and cluster on both sides at once. A vector is thus sent
to as many tasks as there are bands, about the square root of the number of tasks, and each half of the matrix is made once. What a
task leaves, a row a point and cluster, is added up on Spark where a group has several bands. Silhouette, dispersion and separation
follow from these sums, and one pass serves any number of label sets. Bands go by point, not by cluster, so one giant
cluster is no hot task; a group has as many bands as its own size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import small

#: Points that one task takes alone; doubles of a band at most; points of a stream, and those of a band that they meet at once; tasks at most.
BLOCK, BAND_CELLS = 2000, 8_000_000
BATCH, MOST_TASKS = 1024, 20_000
#: Clusters of a label set whose sums are one product.
FEW = 64


def matrix(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
        return 1 - unit(a) @ unit(b).T
    centre = a.mean(axis=0)  # nearby points keep their digits
    a, b = a - centre, b - centre
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0))


def bands(n: int, width: int, tasks: int, block: int = BLOCK) -> int:
    """Bands of ``n`` points: one up to a block; else for a grid of ``tasks`` tasks or a block each, and small enough to be held."""
    blocks = -(-n // block)
    return 1 if blocks <= 1 else min(blocks, max(2, ceil(sqrt(blocks)), ceil(sqrt(2 * tasks)), -(-n * width // BAND_CELLS)))


def cluster_sums(df: DataFrame, vec: str = "vec", labels: str = "labels", group: str | None = None, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(group, run, key, own, other, dist_sum, n_pairs) over all other points of cluster ``other``.

    ``labels`` is an array<int>, a label set each; run is its index. Points of cluster -1 take no part in that run.
    """
    points = df.select(F.col(group).cast("string").alias("group") if group else F.lit("").alias("group"), F.col("key").cast("string").alias("key"), F.col(vec).alias("vec"), F.col(labels).alias("labels"))
    tasks = df.sparkSession.sparkContext.defaultParallelism
    sizes = points.groupBy(F.col("group").alias("_group")).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"))
    many = F.udf(lambda n, width: bands(n, width or 1, tasks, block), "int")  # a row a group
    sizes = sizes.withColumn("bands", many("n", "width"))
    known, named = sizes.agg(F.max("bands"), F.sum(F.expr("bands * (bands + 1) div 2"))).head(), points.withColumn("bands", F.lit(1))
    if (known[0] or 0) > 1:
        large = small(sizes.where("bands > 1").select("_group", F.col("bands").alias("_bands")))  # at most points / block rows
        named = points.join(large, F.col("group").eqNullSafe(F.col("_group")), "left").withColumn("bands", F.coalesce("_bands", F.lit(1))).drop("_group", "_bands")
    own = F.pmod(F.xxhash64("key"), F.col("bands")).cast("int")
    dealt = named.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    dealt = dealt.select("group", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "key", "vec", "labels")
    dealt = dealt.repartition(max(1, min(int(known[1] or 1), MOST_TASKS)), "group", "i", "j").sortWithinPartitions("group", "i", "j", "own")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for batch in batches:
            for part in _stretches(batch):
                place = (part["group"].iloc[0], int(part["i"].iloc[0]), int(part["j"].iloc[0]))
                if at is None or at.place != place:
                    if at is not None:
                        yield from at.rows()
                    at = _BandSums(place, metric)
                yield from at.add(part)
        if at is not None:
            yield from at.rows()

    out = dealt.mapInPandas(sums, "group string, run int, key string, own int, other int, dist_sum double, n_pairs long")
    if (known[0] or 0) <= 1:
        return out
    return out.groupBy("group", "run", "key", "own", "other").agg(F.sum("dist_sum").alias("dist_sum"), F.sum("n_pairs").alias("n_pairs"))


def _stretches(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The parts of a sorted batch that belong to one pair of bands each."""
    group, i, j = batch["group"].fillna("\0").to_numpy(), batch["i"].to_numpy(), batch["j"].to_numpy()
    edges = np.flatnonzero((group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
        if a < b:
            yield batch.iloc[a:b]


class _Sums:
    """Sums of distances of some points, by label set and cluster."""

    def __init__(self, group: str | None, keys: np.ndarray, labels: np.ndarray):
        self.group, self.keys, self.labels, self.sums = group, keys, labels, {}

    def add(self, at: slice, d: np.ndarray, theirs: _Members, begin: int | None = None) -> None:
        """``d``: distances of others (rows) to the points ``at``; ``begin``: where the others stand among all points, if they are some of these."""
        for (run, cluster, member), found in zip(theirs.each, theirs.added(d), strict=True):
            if (run, cluster) not in self.sums:
                self.sums[run, cluster] = np.zeros(len(self.keys)), np.zeros(len(self.keys), np.int64)
            total, count = self.sums[run, cluster]
            total[at] += found
            count[at] += len(member)
            if begin is not None:
                own = begin + member
                count[own[(own >= at.start) & (own < at.stop)]] -= 1

    def rows(self) -> Iterator[pd.DataFrame]:
        for (run, cluster), (total, count) in sorted(self.sums.items()):
            keep = np.flatnonzero((self.labels[:, run] >= 0) & (count > 0))
            if len(keep):
                yield pd.DataFrame({"group": self.group, "run": run, "key": self.keys[keep], "own": self.labels[keep, run], "other": cluster, "dist_sum": total[keep], "n_pairs": count[keep]})


class _Members:
    """The (label set, cluster, places) of some points, noise left out."""

    def __init__(self, labels: np.ndarray):
        self.labels, self.each, self.few = labels, [], []
        for run in range(labels.shape[1]):
            clusters = [c for c in np.unique(labels[:, run]).tolist() if c >= 0]
            self.each += [(run, c, np.flatnonzero(labels[:, run] == c)) for c in clusters]
            self.few += [len(clusters) <= FEW] * len(clusters)

    def added(self, d: np.ndarray) -> list[np.ndarray]:
        """The sums of the rows of ``d`` that belong to each: one product for label sets of few clusters, else cluster by cluster."""
        out: list[np.ndarray] = [d[m].sum(0) if not few else d[0] for (*_, m), few in zip(self.each, self.few, strict=True)] if len(d) else []
        some = [k for k, few in enumerate(self.few) if few]
        for begin in range(0, len(some), 256):
            part = some[begin : begin + 256]
            chosen = np.zeros((len(part), len(d)))
            for row, k in enumerate(part):
                chosen[row, self.each[k][2]] = 1
            for k, total in zip(part, chosen @ d, strict=True):
                out[k] = total
        return out


class _BandSums:
    """A pair of bands: the points of the first come first and stay, those of the second stream by. A band with itself only stays.

    Distances are made in tiles of ``BATCH`` x ``BATCH``, whatever the size of the bands.
    """

    def __init__(self, place: tuple, metric: str):
        self.place, self.metric, self.parts, self.mine, self.vecs = place, metric, [], None, None

    def add(self, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        guest = part["own"].to_numpy() != self.place[1]
        if not guest.all():
            own = part[~guest]
            self.parts.append((own["key"].to_numpy(), np.stack(own["vec"]), np.stack(own["labels"])))
        guests = part[guest]
        for begin in range(0, len(guests), BATCH):
            some = guests.iloc[begin : begin + BATCH]
            if self._begin():
                x, theirs = np.stack(some["vec"]), _Members(np.stack(some["labels"]))
                other = _Sums(self.place[0], some["key"].to_numpy(), theirs.labels)
                for at, members in self.tiles:
                    d = matrix(self.vecs[at], x, self.metric)
                    other.add(slice(0, len(x)), d, members)
                    self.mine.add(at, d.T, theirs)
                yield from other.rows()

    def _begin(self) -> bool:
        """Whether the first band has points, now that all of them have come."""
        if self.parts:
            keys, vecs, labels = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            self.vecs, self.mine, self.parts = vecs, _Sums(self.place[0], keys, labels), []
            self.tiles = [(slice(k, min(k + BATCH, len(keys))), _Members(labels[k : k + BATCH])) for k in range(0, len(keys), BATCH)]
        return self.mine is not None

    def rows(self) -> Iterator[pd.DataFrame]:
        if not self._begin():
            return
        if self.place[1] == self.place[2]:
            for s, (p, own) in enumerate(self.tiles):
                for q, others in self.tiles[s:]:
                    d = matrix(self.vecs[p], self.vecs[q], self.metric)
                    if p == q:
                        d = (d + d.T) / 2
                        np.fill_diagonal(d, 0)
                    else:
                        self.mine.add(p, d.T, others)
                    self.mine.add(q, d, own, p.start)
        yield from self.mine.rows()


def with_labels(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.withColumn("labels", F.array(F.col(cluster).cast("int")))


def silhouette(sums: DataFrame) -> DataFrame:
    """(group, run, silhouette, n_points, n_clusters): the mean over points, 0 for points alone in their cluster.

    Null with fewer than two clusters. A point has sums to every other cluster; its own cluster is missing when it is alone.
    """
    mean = F.col("dist_sum") / F.col("n_pairs")
    per = sums.groupBy("group", "run", "key", "own").agg(F.min(F.when(F.col("own") == F.col("other"), mean)).alias("a"), F.min(F.when(F.col("own") != F.col("other"), mean)).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    out = per.withColumn("s", s).groupBy("group", "run").agg(F.avg("s").alias("silhouette"), F.count("*").alias("n_points"), F.count_distinct("own").alias("n_clusters"))
    return out.withColumn("silhouette", F.when(F.col("n_clusters") >= 2, F.col("silhouette")))


def dispersion(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, run, cluster, dispersion): mean distance of pairs within a cluster; 0 for a single point.

    ``sizes`` names all clusters: (group, run, cluster).
    """
    own = sums.where("own = other").groupBy("group", "run", F.col("own").alias("cluster")).agg((F.sum("dist_sum") / F.sum("n_pairs")).alias("dispersion"))
    return sizes.where("cluster >= 0").select("group", "run", "cluster").distinct().join(own, ["group", "run", "cluster"], "left").withColumn("dispersion", F.coalesce("dispersion", F.lit(0.0)))


def pair_separation(sums: DataFrame, aggregate: str = "mean") -> DataFrame:
    """(group, run, h, f, sep) for clusters h < f: mean (or sum) of all distances across."""
    agg = F.sum("dist_sum") / F.sum("n_pairs") if aggregate == "mean" else F.sum("dist_sum")
    return sums.where("own < other").groupBy("group", "run", F.col("own").alias("h"), F.col("other").alias("f")).agg(agg.alias("sep"))


def cluster_separation(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, run, cluster, min_sep, min_pair, mean_sep, max_sep, max_pair); the smallest partner among equals.

    Clusters without another cluster have zeros and null partners.
    """
    both = pairs.select("group", "run", F.col("h").alias("cluster"), F.col("f").alias("partner"), "sep").union(pairs.select("group", "run", "f", "h", "sep"))
    near, far = F.struct("sep", "partner"), F.struct("sep", -F.col("partner"))
    stats = both.groupBy("group", "run", "cluster").agg(F.min("sep").alias("min_sep"), F.min_by("partner", near).alias("min_pair"), F.avg("sep").alias("mean_sep"), F.max("sep").alias("max_sep"), F.max_by("partner", far).alias("max_pair"))
    out = sizes.where("cluster >= 0").select("group", "run", "cluster").distinct().join(stats, ["group", "run", "cluster"], "left")
    return out.na.fill(0.0, ["min_sep", "mean_sep", "max_sep"])


def label_sets(df: DataFrame, labels: str = "labels", group: str | None = None) -> DataFrame:
    """(group, run, cluster, size) of all label sets."""
    name = F.col(group).cast("string") if group else F.lit("")
    return df.select(name.alias("group"), F.posexplode(labels).alias("run", "cluster")).groupBy("group", "run", "cluster").agg(F.count("*").alias("size"))


