"""An index of inverted lists over vectors: nearest neighbours, and density clusters over the graph that they make.

The lists' centres are fit on a bounded sample (``SAMPLE_CELLS`` doubles); every vector is in the list of its nearest centre. A search
asks the lists of the nearest ``probes`` centres, by default as many as hold ``RECALL`` of the neighbours that ``MEASURED`` points have
among all; an exact one then asks those lists, too, that by the triangle inequality may hold
something nearer than the k-th found so far. A list is dealt over blocks and those that ask it over parts, so that a task meets some
thousand vectors of each side, whatever the size of the list. Cosine distances are searched as euclidean ones between unit vectors.

Density: copies of a vector are one point with a weight, and hang on it by edges of its core distance. Boruvka rounds take the lightest
edge of the neighbour graph out of each component; lists are only asked for points whose graph may lack a lighter one, and for
components that the graph doesn't link to any other, so the tree spans all points. Nothing a point or component reaches the driver.
"""

from __future__ import annotations

from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BROADCAST_CELLS, small
from .distance import BATCH, BLOCK, bands, matrix
from .keep import keep, stored
from .rounds import lightest, on_grid, roots, tree_clusters

#: Doubles of the sample that centres are fit on; steps of the fit; points that ask a block of a list in one task.
SAMPLE_CELLS, STEPS, ASKED = 4_000_000, 4, 8000
#: Points whose neighbours are found by brute force to choose ``probes``, and the part of these that the lists asked must hold.
MEASURED, RECALL = 500, 0.95
#: Bounds are widened by this part, so that rounding loses nothing.
SLACK = 1e-7


class Index(NamedTuple):
    rows: DataFrame  # (idx, vec, list), kept
    centres: np.ndarray
    bands: int  # of a grid of all pairs: how often it copies a vector
    radius: np.ndarray  # of each list; -1 where it is empty
    zero: np.ndarray  # whether a list holds a vector of length 0, whose cosine distances are all 1
    metric: str


def _flat(x: np.ndarray, metric: str) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1) if metric == "cosine" else x


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    centres = sample[:n].copy()
    for _ in range(STEPS):
        own = np.concatenate([matrix(sample[i : i + BATCH], centres).argmin(1) for i in range(0, len(sample), BATCH)])
        count, total = np.bincount(own, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def build(points: DataFrame, metric: str = "euclidean") -> Index:
    """The index of ``points`` (idx, vec), idx unique: about sqrt(n) lists, fewer if their centres were over the bound of a broadcast."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = points.sparkSession
    n, width = points.agg(F.count("*"), F.max(F.size("vec"))).head()
    some = points.orderBy(F.xxhash64("idx"), "idx").limit(max(1, SAMPLE_CELLS // (width or 1))).select("vec").toPandas()["vec"]  # bounded by SAMPLE_CELLS
    sample = _flat(np.stack(some).astype(float), metric) if len(some) else np.zeros((1, 1))
    centres = _centres(sample, max(1, min(ceil(sqrt(n)), BROADCAST_CELLS // (width or 1))))
    sent = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("list int, far double, none boolean")
    def place(vecs: pd.Series) -> pd.DataFrame:
        x = _flat(np.stack(vecs).astype(float), metric) if len(vecs) else np.zeros((0, sent.value.shape[1]))
        out = []
        for i in range(0, len(x), BATCH):
            d = matrix(x[i : i + BATCH], sent.value)
            out.append(pd.DataFrame({"list": d.argmin(1), "far": d.min(1), "none": ~x[i : i + BATCH].any(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"list": [], "far": [], "none": []})

    rows = keep(points.select("idx", "vec", place("vec").alias("at")).select("idx", "vec", "at.*"))
    radius, zero = np.full(len(centres), -1.0), np.zeros(len(centres), bool)
    for r in rows.groupBy("list").agg(F.max("far").alias("far"), F.max("none").alias("none")).collect():  # a row a list
        radius[r["list"]], zero[r["list"]] = r["far"] * (1 + SLACK) + SLACK, r["none"]
    return Index(rows.select("idx", "vec", "list"), centres, bands(n, width or 1, spark.sparkContext.defaultParallelism), radius, zero, metric)


def _bounds(index: Index, centres: np.ndarray, vecs: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances to the centres, and the least and largest distance, in the index's metric, to anything in each list."""
    x = _flat(np.stack(vecs).astype(float), index.metric)
    d = matrix(x, centres)
    low, high = np.maximum(d * (1 - SLACK) - index.radius - SLACK, 0), d * (1 + SLACK) + index.radius + SLACK
    if index.metric == "cosine":
        low, high = low * low / 2, high * high / 2
        high = np.where(index.zero[None, :] | ~x.any(axis=1)[:, None], np.maximum(high, 1), high)
    return d, low, high


def _meet(stored_rows: DataFrame, asked: DataFrame, run, schema: str) -> DataFrame:
    """``run(stored, asking)`` for each block of a list and each part of the points that ask it."""
    have = stored_rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = small(have.join(asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts")), "list"))
    at = F.xxhash64("idx")
    ours = stored_rows.join(sizes, "list").withColumn("block", F.pmod(at, "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    theirs = asked.join(sizes, "list").withColumn("part", F.pmod(at, "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = ours.withColumn("asks", F.lit(False)).unionByName(theirs.withColumn("asks", F.lit(True))).drop("blocks", "parts")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        own, asking = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        found = [run(own, asking.iloc[i : i + BATCH]) for i in range(0, len(asking), BATCH)] if len(own) else []
        return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return both.groupBy("list", "block", "part").applyInPandas(task, schema)


def _own(index: Index):
    return F.pmod(F.xxhash64("idx"), F.lit(index.bands)).cast("int")


def _asked(index: Index, points: DataFrame) -> DataFrame | None:
    """``points`` with a row for each of their ``lists``; None if these copy vectors more often than a grid of all pairs."""
    points = stored(points)
    if (points.agg(F.sum(F.size("lists"))).head()[0] or 0) > index.bands * index.rows.count():
        return None
    return points.withColumn("list", F.explode("lists")).drop("lists")


_FOUND = "idx long, d array<double>, to array<long>"


def _few(k: int, metric: str):
    """The ``k`` nearest of a block to each point that asks it."""

    def run(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        d = np.maximum(matrix(np.stack(asking["vec"]).astype(float), np.stack(own["vec"]).astype(float), metric), 0)
        ids, to = own["idx"].to_numpy(), np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        return pd.DataFrame({"idx": asking["idx"].to_numpy(), "d": list(np.take_along_axis(d, to, axis=1)), "to": list(ids[to])})

    return run


def _by_grid(index: Index, k: int) -> DataFrame:
    """``nearest`` by comparing all pairs."""
    few = _few(k, index.metric)

    def run(pairs) -> pd.DataFrame:
        held: dict[int, tuple] = {}
        for a, p, b, q, same in pairs:
            sides = [pd.DataFrame({"idx": x.rows["idx"][s], "vec": list(x.x[s])}) for x, s in ((a, p), (b, q))]
            for own, asking in ((sides[0], sides[1]), (sides[1], sides[0]))[: 1 if same else 2]:
                for i, d, to in few(own, asking).itertuples(index=False):
                    if i in held:
                        d, to = np.concatenate([held[i][0], d]), np.concatenate([held[i][1], to])
                        best = np.lexsort((to, d))[:k]
                        d, to = d[best], to[best]
                    held[i] = d, to
        return pd.DataFrame([(i, *row) for i, row in held.items()], columns=["idx", "d", "to"])

    return stored(_merged(on_grid(index.rows.select("idx", "vec"), _own(index), index.bands, "idx", BLOCK, run, _FOUND), k))


def _merged(found: DataFrame, k: int) -> DataFrame:
    pieces = found.select("idx", F.arrays_zip("d", "to").alias("near")) if "near" not in found.columns else found
    return pieces.groupBy("idx").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def measured_probes(index: Index, k: int, recall: float = RECALL) -> int:
    """The least number of lists that, nearest centre first, hold ``recall`` of the ``k`` nearest of ``MEASURED`` points among all points."""
    sent, full = index.rows.sparkSession.sparkContext.broadcast(index.centres), np.flatnonzero(index.radius >= 0)
    known = index._replace(rows=None, centres=None)
    some = keep(stored(index.rows.orderBy(F.xxhash64("idx", F.lit(1)), "idx").limit(MEASURED)))
    asked = some.select("idx", "vec", F.explode(F.array(*map(F.lit, full.tolist()))).alias("list"))
    near = _merged(_meet(index.rows, asked, _few(k, index.metric), _FOUND), k).select("idx", F.explode("near.to").alias("to"))
    lists = near.join(index.rows.select(F.col("idx").alias("to"), "list"), "to").groupBy("idx").agg(F.collect_list("list").alias("lists"))

    @F.pandas_udf("array<int>")
    def places(vecs: pd.Series, lists: pd.Series) -> pd.Series:
        d = _bounds(known, sent.value, vecs)[0][:, full] if len(vecs) else np.zeros((0, len(full)))
        rank = d.argsort(axis=1).argsort(axis=1)
        return pd.Series([r[np.searchsorted(full, at)].astype(np.int32) for r, at in zip(rank, lists, strict=True)], dtype=object)

    counts = some.join(lists, "idx").select(F.explode(places("vec", "lists")).alias("place")).groupBy("place").count().orderBy("place").collect()  # at most a row a list
    within = np.cumsum([r["count"] for r in counts])
    return int(counts[int(np.searchsorted(within, recall * within[-1]))]["place"]) + 1 if counts else 1


def nearest(index: Index, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(idx, near), near the k nearest as (d, to) by rising distance, a point itself included; all points if there are no more.

    Unless ``exact``, neighbours in lists further off than ``probes`` (None: measured) may be missed, but a point always has k of them.
    Where the lists to be asked would copy vectors more often than a grid of all pairs does, the grid is taken, which misses nothing.
    """
    sent = index.rows.sparkSession.sparkContext.broadcast(index.centres)
    metric, empty, known = index.metric, index.radius < 0, index._replace(rows=None, centres=None)
    probes = min(probes or (min(8, index.bands) if exact else measured_probes(index, k)), max(1, int((~empty).sum())))

    @F.pandas_udf("array<int>")
    def first(vecs: pd.Series) -> pd.Series:
        d = _bounds(known, sent.value, vecs)[0] if len(vecs) else np.zeros((0, len(sent.value)))
        d[:, empty] = np.inf
        return pd.Series(list(np.argpartition(d, probes - 1, axis=1)[:, :probes].astype(np.int32)))

    @F.pandas_udf("array<int>")
    def further(vecs: pd.Series, most: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        d, low, _ = _bounds(known, sent.value, vecs)
        d[:, empty] = np.inf
        done = np.zeros(d.shape, bool)
        np.put_along_axis(done, np.argpartition(d, probes - 1, axis=1)[:, :probes], True, axis=1)
        return pd.Series([np.flatnonzero(r).astype(np.int32) for r in (low <= most.fillna(np.inf).to_numpy(float)[:, None]) & ~done & ~empty[None, :]])

    if probes > index.bands:
        return _by_grid(index, k)
    points = index.rows.select("idx", "vec")
    found = stored(_merged(_meet(index.rows, points.withColumn("list", F.explode(first("vec"))), _few(k, metric), _FOUND), k))
    rest = points.join(found, "idx").select("idx", "vec", F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))["d"]).alias("most"))
    asked = rest if exact else rest.where("most is null")
    asked = _asked(index, asked.select("idx", "vec", further("vec", "most").alias("lists")))
    if asked is None:
        return _by_grid(index, k)
    if asked.isEmpty():
        return found
    return stored(_merged(found.unionByName(_merged(_meet(index.rows, asked, _few(k, metric), _FOUND), k)), k))


def neighbours(df: DataFrame, k: int, metric: str = "euclidean", probes: int | None = None, exact: bool = False) -> DataFrame:
    """(key, rank, to, d): the ``k`` nearest other points of each point of ``df`` (key, vec), keys unique; fewer if there are fewer."""
    points = keep(df.select(F.xxhash64("key").alias("idx"), F.col("key"), "vec"))
    if points.groupBy("idx").count().where("count > 1").isEmpty():
        ids = points
    else:  # keys that share a hash, or repeat
        ids = keep(stored(df.select(F.monotonically_increasing_id().alias("idx"), "key", "vec")))
    near = nearest(build(ids.select("idx", "vec"), metric), k + 1, probes, exact)
    others = near.select("idx", F.slice(F.filter("near", lambda p: p["to"] != F.col("idx")), 1, k).alias("near")).select("idx", F.posexplode("near").alias("pos", "p"))
    named = others.select("idx", (F.col("pos") + 1).alias("rank"), F.col("p.to").alias("other"), F.col("p.d").alias("d")).join(ids.select("idx", "key"), "idx")
    return named.join(ids.select(F.col("idx").alias("other"), F.col("key").alias("to")), "other").select("key", "rank", "to", "d")


def _search(index: Index, asked: DataFrame, state: DataFrame) -> DataFrame:
    """(w, a, b, ca, cb): for points ``asked`` (idx, c, most) the lightest edges out of their component that weigh ``most`` or less;
    where it is null, the lightest of the component. ``state``: (idx, c, core) of all points."""
    rows = keep(index.rows.join(state, "idx"))
    count = len(index.centres)
    c_low, c_high, r_low, r_high = np.full(count, -1), np.full(count, -1), np.zeros(count), np.full(count, np.inf)
    for r in rows.groupBy("list").agg(F.min("c"), F.max("c"), F.min("core"), F.max("core")).collect():  # a row a list
        c_low[r[0]], c_high[r[0]], r_low[r[0]], r_high[r[0]] = r[1:]
    sent = rows.sparkSession.sparkContext.broadcast((index.centres, c_low, c_high, r_low, r_high))
    known, metric, empty = index._replace(rows=None, centres=None), index.metric, index.radius < 0

    def bounds(vecs, c, core):
        centres, lo, hi, least, most = sent.value
        _, low, high = _bounds(known, centres, vecs)
        out = empty[None, :] | ((lo == hi)[None, :] & (lo[None, :] == c.to_numpy()[:, None]))
        core = core.to_numpy(float)[:, None]
        return np.where(out, np.inf, np.maximum(np.maximum(low, core), least)), np.where(out, np.inf, np.maximum(np.maximum(high, core), most))

    @F.pandas_udf("double")
    def ceiling(vecs: pd.Series, c: pd.Series, core: pd.Series) -> pd.Series:
        return pd.Series(bounds(vecs, c, core)[1].min(1) if len(vecs) else [], dtype=float)

    @F.pandas_udf("array<int>")
    def may(vecs: pd.Series, c: pd.Series, core: pd.Series, most: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        low = bounds(vecs, c, core)[0]
        return pd.Series([np.flatnonzero(r).astype(np.int32) for r in (low <= most.to_numpy(float)[:, None]) & np.isfinite(low)])

    points = rows.select("idx", "vec", "c", "core").join(asked.select("idx", "most"), "idx")
    open_ = points.where("most is null")
    tops = open_.groupBy("c").agg(F.min(ceiling("vec", "c", "core")).alias("top"))
    points = points.where("most is not null").unionByName(open_.drop("most").join(tops, "c").select("idx", "vec", "c", "core", F.col("top").alias("most")))

    def run(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        d = np.maximum(matrix(np.stack(asking["vec"]).astype(float), np.stack(own["vec"]).astype(float), metric), 0)
        d = np.maximum(d, np.maximum(asking["core"].to_numpy()[:, None], own["core"].to_numpy()[None, :]))
        mine, theirs = asking["c"].to_numpy(), own["c"].to_numpy()
        d[mine[:, None] == theirs[None, :]] = np.inf
        to = d.argmin(1)
        w, a, b = d[np.arange(len(d)), to], asking["idx"].to_numpy(), own["idx"].to_numpy()[to]
        out = pd.DataFrame({"w": w, "a": np.minimum(a, b), "b": np.maximum(a, b), "ca": np.where(a < b, mine, theirs[to]), "cb": np.where(a < b, theirs[to], mine), "c": mine})
        out = out[np.isfinite(w)].sort_values(["w", "a", "b"])
        return out.drop_duplicates("c")  # one edge a component and task

    asks = _asked(index, points.withColumn("lists", may("vec", "c", "core", "most")).drop("most"))
    if asks is None:  # all pairs
        edges = on_grid(rows.drop("list"), _own(index), index.bands, "idx", BLOCK, lambda pairs: lightest(pairs, metric), "c long, w double, a long, b long, to long")
        return edges.groupBy("c").agg(F.min(F.struct("w", "a", "b", "to")).alias("m")).select("m.w", "m.a", "m.b", F.col("c").alias("ca"), F.col("m.to").alias("cb"))
    edges = _meet(rows.select("list", "idx", "vec", "c", "core"), asks, run, "w double, a long, b long, ca long, cb long, c long")
    return edges.groupBy("c").agg(F.min(F.struct("w", "a", "b", "ca", "cb")).alias("m")).select("m.*").distinct()


def graph_tree(points: DataFrame, n: int, min_samples: int, metric: str, k: int = 16, probes: int | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(w, a, b), the n - 1 edges of a spanning tree over mutual reachability, and (idx, core), for ``points`` (idx, vec).

    With ``exact`` it is the least spanning tree (equal edges aside); else core distances and edges are those of the ``k`` neighbours found.
    """
    need = min(min_samples, n - 1) + 1
    size = max(k, need)
    classes = keep(points.groupBy("vec").agg(F.min("idx").alias("idx"), F.count("*").alias("n")))
    index = build(classes.select("idx", "vec"), metric)
    near = nearest(index, size, probes, exact)
    weights = small(classes.where("n > 1").select(F.col("idx").alias("to"), "n"))
    pairs = near.select("idx", F.explode("near").alias("p")).select("idx", "p.d", "p.to").join(weights, "to", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    so_far = F.sum("n").over(Window.partitionBy("idx").orderBy("d", "to").rowsBetween(Window.unboundedPreceding, 0))
    core = pairs.withColumn("so_far", so_far).groupBy("idx").agg(F.min(F.when(F.col("so_far") >= need, F.col("d"))).alias("core"), F.max("d").alias("reach"), F.count("*").alias("found"))
    core = stored(core.select("idx", "core", F.when(F.col("found") >= size, F.col("reach")).otherwise(F.lit(float("inf"))).alias("reach")))  # all points found: the graph lacks nothing of it
    graph = pairs.where("idx <> to").select(F.least("idx", "to").alias("a"), F.greatest("idx", "to").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    for c in ("a", "b"):
        graph = graph.join(core.select(F.col("idx").alias(c), F.col("core").alias(f"core_{c}")), c)
    graph = stored(graph.select(F.greatest("d", "core_a", "core_b").alias("w"), "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    member, parts, tree = stored(core.select("idx", F.col("idx").alias("c"))), core.count(), []

    def best_of(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.col("ca").alias("c"), "w", "a", "b", F.col("cb").alias("to")).unionByName(edges.select(F.col("cb").alias("c"), "w", "a", "b", F.col("ca").alias("to")))
        return ends.groupBy("c").agg(F.min(F.struct("w", "a", "b", "to")).alias("m")).select("c", "m.*")

    while parts > 1:
        best = stored(best_of(graph))
        state = member.join(core, "idx").join(best.select("c", F.col("w").alias("most")), "c", "left")
        lacking = state.where(F.col("most").isNull() | (F.greatest("core", "reach") < F.col("most")) if exact else F.col("most").isNull())
        asked = stored(lacking.select("idx", "c", "most"))
        if not asked.isEmpty():
            found = stored(_search(index, asked, member.join(core.select("idx", "core"), "idx")))
            graph = stored(graph.unionByName(found))
            best = stored(best_of(graph))
        tree.append(best.select("w", "a", "b").distinct())
        back = best.select(F.col("to").alias("c"), F.col("c").alias("to"))
        ends = best.join(back, ["c", "to"]).where("c < to").select("c")  # two that take the same edge: the smaller is the end of the chain
        up = roots(best.join(ends, "c", "left_anti").select(F.col("c").alias("a"), F.col("to").alias("b")))
        parts -= up.count()
        up = up.select(F.col("a").alias("_from"), F.col("b").alias("_to"))

        def moved(df: DataFrame, c: str, up=up) -> DataFrame:
            return df.join(up, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")

        member, graph = stored(moved(member, "c")), stored(moved(moved(graph, "ca"), "cb").where("ca <> cb"))
    own = points.join(small(classes.where("n > 1").select("vec", F.col("idx").alias("rep")), F.size("vec")), "vec").where("idx <> rep").select("idx", "rep")
    copies = stored(own.join(core.select(F.col("idx").alias("rep"), "core"), "rep"))
    edges = copies.select(F.col("core").alias("w"), F.col("rep").alias("a"), F.col("idx").alias("b"))
    for part in tree:
        edges = edges.unionByName(part)
    return stored(edges), stored(core.select("idx", "core").unionByName(copies.select("idx", "core")))


def density_by_graph(points: DataFrame, n: int, min_size: int, min_samples: int, eps: float, metric: str, **search) -> DataFrame:
    """(idx, cluster) of ``points`` (idx 0..n-1, vec), clusters numbered by their first point, -1 for noise; ``search``: see ``graph_tree``."""
    edges, core = graph_tree(points, n, min_samples, metric, **search)
    return tree_clusters(edges, core, n, min_size, eps)
