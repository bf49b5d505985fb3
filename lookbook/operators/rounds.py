"""Exact hierarchies and density trees of a group that is too large for one task, as tables.

Points are numbered by key. What is known of them (the cluster that each belongs to, its core distance) and of clusters (size,
inner squares, the merge that made them) are tables, joined to the points in every round; merges, edges and names are made by joins. No
row a point or cluster reaches the driver. In a round points are dealt over bands, and each pair of bands is a task that leaves a row a
cluster: its nearest cluster, or its lightest edge out. Hierarchy: mutually nearest clusters merge in each round, which for
Ward, average and complete linkage gives the tree of one merge at a time (equal distances aside); when ``cap`` clusters are left,
their distances fit one task. Density: Boruvka rounds over mutual reachability, components by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distance import BLOCK, bands, matrix
from .keep import cut, keep, stored
from .lists import by_means
from .passes import MOST_CELLS, merges_by_lists
from .trees import chain_merges, tree_labels

_MERGE = "seq long, a long, b long, h double, size double, left long, right long"


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, kept, with ``name``: 0, 1, 2... in the order of unique ``order``. Rows are sorted in ranges; a row a range is added up."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(max(2, tasks), *order).sortWithinPartitions(*order)).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    starts = ranged.groupBy("_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = starts.select("_part", (before - F.col("_first")).alias("_shift"))
    return keep(ranged.join(F.broadcast(table), "_part").withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"))


def numbered(points: DataFrame) -> tuple[DataFrame, int]:
    """(idx, key, vec), kept, with idx 0..n-1 in the order of key; and n."""
    out = keep(placed(points.select("key", "vec"), ["key"], "idx").select("idx", "key", "vec").repartition("idx"))  # joins by idx don't move vectors
    return out, out.count()


class _Band:
    """Points of a band, sorted by cluster; ``chunks`` are of whole clusters, but for those of over ``block`` points."""

    def __init__(self, rows: pd.DataFrame, by: str, block: int):
        rows = rows.sort_values([by, "idx"], kind="stable")
        self.rows, self.x = {c: rows[c].to_numpy() for c in rows.columns if c not in ("vec", "i", "j", "own")}, np.stack(rows["vec"]).astype(float)
        _, counts = np.unique(self.rows[by], return_counts=True)
        self.chunks, begin, end = [], 0, 0
        for n in counts.tolist():
            if end > begin and end + n - begin > block:
                self.chunks.append(slice(begin, end))
                begin = end
            end += n
            while end - begin > block:
                self.chunks.append(slice(begin, begin + block))
                begin += block
        if end > begin:
            self.chunks.append(slice(begin, end))


def on_grid(rows: DataFrame, own, n_bands: int, by: str, block: int, run: Callable[[Iterator], pd.DataFrame], schema: str) -> DataFrame:
    """``run(pairs)`` of each pair of bands; pairs are (band, chunk, band, chunk, same)."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        parts = [pdf[pdf["own"] == k] for k in ((i,) if i == j else (i, j))]
        if not all(len(p) for p in parts):
            return run(iter(()))
        sides = [_Band(p, by, block) for p in parts]
        a, b = sides[0], sides[-1]
        return run((a, p, b, q, i == j and s == t) for s, p in enumerate(a.chunks) for t, q in enumerate(b.chunks) if i != j or s <= t)

    dealt = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))))
    dealt = dealt.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("with")
    return dealt.repartition(n_bands * (n_bands + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(task, schema)  # few bytes, much work: not to be coalesced


def _distances(a: _Band, p: slice, b: _Band, q: slice, same: bool, metric: str) -> np.ndarray:
    d = matrix(a.x[p], b.x[q], metric)
    return (d + d.T) / 2 if same else d


def _pair_table(a, p, b, q, same, linkage, metric):
    """Clusters of both chunks, where they begin, and the sums (or maxima) over their pairs."""
    op, d = np.maximum if linkage == "complete" else np.add, _distances(a, p, b, q, same, metric)
    d = d * d if linkage == "ward" else d
    ca, sa = np.unique(a.rows["c"][p], return_index=True)
    cb, sb = np.unique(b.rows["c"][q], return_index=True)
    return ca, sa, cb, sb, op.reduceat(op.reduceat(d, sa, axis=0), sb, axis=1)


def _height(linkage: str, raw, wa, wb, sa, sb):
    if linkage == "complete":
        return raw
    mean = raw / (wa * wb)
    return mean if linkage == "average" else np.sqrt(np.maximum(2 * wa * wb / (wa + wb) * (mean - sa / wa - sb / wb), 0))


def _nearest(pairs, linkage: str, metric: str, block: int) -> pd.DataFrame:
    """The nearest cluster of each whole cluster, and the raw sums of clusters that have parts elsewhere."""
    near: dict[int, tuple] = {}
    parts = []
    for a, p, b, q, same in pairs:
        ca, sa, cb, sb, raw = _pair_table(a, p, b, q, same, linkage, metric)
        (wa, ia), (wb, ib) = ((x.rows["w"][s][at], x.rows["inner"][s][at]) for x, s, at in ((a, p, sa), (b, q, sb)))
        d = _height(linkage, raw, wa[:, None], wb[None, :], ia[:, None], ib[None, :])
        d[ca[:, None] == cb[None, :]] = np.inf
        split = (wa[:, None] > block) | (wb[None, :] > block)
        if split.any():
            r, c = np.nonzero(split & np.isfinite(d))
            parts += [pd.DataFrame({"a": x, "b": y, "raw": raw[r, c]}) for x, y in ((ca[r], cb[c]),) + (() if same else ((cb[c], ca[r]),))]
            d[split] = np.inf
        for mine, theirs, m in ((ca, cb, d), (cb, ca, d.T))[: 1 if same else 2]:
            to = m.argmin(1)
            for x, y, v in zip(mine.tolist(), theirs[to].tolist(), m[np.arange(len(mine)), to].tolist(), strict=True):
                if v < np.inf and (v, y) < near.get(x, (np.inf, 0)):
                    near[x] = v, y
    found = pd.DataFrame([(x, y, v) for x, (v, y) in near.items()], columns=["a", "b", "d"])
    return pd.concat([found.assign(raw=np.nan), *(p.assign(d=np.nan) for p in parts)])[["a", "b", "d", "raw"]].astype({"a": "int64", "b": "int64", "d": float, "raw": float})


def merges(points: DataFrame, n: int, linkage: str, metric: str, cap: int, block: int = BLOCK) -> DataFrame:
    """(seq, a, b, h, size, left, right): the n - 1 merges. Cluster a goes up in b; left and right are the merges that made them, or null."""
    if linkage not in ("ward", "average", "complete"):
        raise ValueError(f"unknown linkage {linkage!r}")
    spark = points.sparkSession
    width = points.select(F.size("vec").alias("d")).head()["d"]
    if by_means(linkage, metric) and n * width <= MOST_CELLS:
        return merges_by_lists(points.select("idx", "vec"), metric)
    n_bands = bands(n, width, spark.sparkContext.defaultParallelism, block)
    member = points.select("idx", F.col("idx").alias("c"))
    state = member.select("c", F.lit(1.0).alias("w"), F.lit(0.0).alias("inner"), F.lit(None).cast("long").alias("last"))
    out, live, step = [], n, 0

    def rows() -> DataFrame:
        return points.select("idx", "vec").join(member, "idx").join(state.select("c", "w", "inner"), "c")

    own = F.pmod(F.xxhash64(F.when(F.col("w") > block, F.col("idx")).otherwise(F.col("c"))), F.lit(n_bands)).cast("int")  # small clusters are whole in a band
    mean = F.col("raw") / (F.col("wa") * F.col("wb"))
    ward = F.sqrt(F.greatest(2 * F.col("wa") * F.col("wb") / (F.col("wa") + F.col("wb")) * (mean - F.col("sa") / F.col("wa") - F.col("sb") / F.col("wb")), F.lit(0.0)))
    height = {"ward": ward, "average": mean, "complete": F.col("raw")}[linkage]
    while live > max(1, cap):
        found = on_grid(rows(), own, n_bands, "c", block, lambda pairs: _nearest(pairs, linkage, metric, block), "a long, b long, d double, raw double")
        found = stored(found)
        parts = found.where("raw is not null").groupBy("a", "b").agg((F.max if linkage == "complete" else F.sum)("raw").alias("raw"))
        for k in ("a", "b"):
            parts = parts.join(state.select(F.col("c").alias(k), F.col("w").alias(f"w{k}"), F.col("inner").alias(f"s{k}")), k)
        whole = parts.select("a", "b", height.alias("d")).union(found.where("raw is null").select("a", "b", "d"))
        best = stored(whole.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b", "m.d"))
        back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
        mutual = best.join(back, ["a", "b"]).where("a < b")
        if mutual.isEmpty():  # equal distances in a ring
            mutual = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").orderBy("d", "a", "b").limit(1)
        for k in ("a", "b"):
            mutual = mutual.join(state.select(F.col("c").alias(k), *(F.col(x).alias(f"{x}_{k}") for x in ("w", "inner", "last"))), k)
        done = stored(mutual.select((F.lit(step * 2**40).cast("long") + F.col("a")).alias("seq"), "a", "b", F.col("d").alias("h"), (F.col("w_a") + F.col("w_b")).alias("size"), F.col("last_a").alias("left"), F.col("last_b").alias("right"), "inner_a"))
        out.append(done.drop("inner_a"))
        member = stored(member.join(done.select(F.col("a").alias("c"), "b"), "c", "left").select("idx", F.coalesce("b", "c").alias("c")))
        state = state.join(done.select(F.col("a").alias("c")), "c", "left_anti").join(done.select(F.col("b").alias("c"), "seq", "h", "size", "inner_a"), "c", "left")
        state = stored(state.select("c", F.coalesce("size", "w").alias("w"), F.when(F.col("seq").isNull(), F.col("inner")).otherwise(F.col("inner") + F.col("inner_a") + F.col("h") * F.col("h") / 2).alias("inner"), F.coalesce("seq", "last").alias("last")))
        live, step = live - done.count(), step + 1
    out.append(_last_merges(rows().join(state.select("c", "last"), "c"), own, n_bands, block, linkage, metric, step))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return stored(whole)


def _last_merges(rows: DataFrame, own, n_bands: int, block: int, linkage: str, metric: str, step: int) -> DataFrame:
    """The merges of the clusters that are left, at most as many as one task holds distances of."""

    def pairs_of(pairs) -> pd.DataFrame:
        out = []
        for a, p, b, q, same in pairs:
            ca, sa, cb, sb, raw = _pair_table(a, p, b, q, same, linkage, metric)
            about = [np.stack([x.rows[k][s][at].astype(float) for k in ("w", "inner", "last")]) for x, s, at in ((a, p, sa), (b, q, sb))]
            out.append((ca.tobytes(), cb.tobytes(), about[0].tobytes(), about[1].tobytes(), same, raw.tobytes()))
        return pd.DataFrame(out, columns=["ca", "cb", "ia", "ib", "same", "raw"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        op, known, tables = np.maximum if linkage == "complete" else np.add, {}, []
        for r in pdf.itertuples():
            ca, cb = np.frombuffer(r.ca, np.int64), np.frombuffer(r.cb, np.int64)
            for c, about in ((ca, r.ia), (cb, r.ib)):
                known |= dict(zip(c.tolist(), np.frombuffer(about).reshape(3, -1).T.tolist(), strict=True))
            tables.append((ca, cb, r.same, np.frombuffer(r.raw).reshape(len(ca), len(cb))))
        left = np.array(sorted(known), np.int64)
        raw = np.zeros((len(left), len(left)))
        for ca, cb, same, part in tables:
            a, b = np.searchsorted(left, ca), np.searchsorted(left, cb)
            raw[np.ix_(a, b)] = op(raw[np.ix_(a, b)], part)
            if not same:
                raw[np.ix_(b, a)] = op(raw[np.ix_(b, a)], part.T)
        w, inner, last = (np.array([known[c][k] for c in left.tolist()]) for k in range(3))
        d = _height(linkage, raw, w[:, None], w[None, :], inner[:, None], inner[None, :])
        made, size, out = [None if v < 0 else int(v) for v in last.tolist()], w.copy(), []
        for k, (a, b, h) in enumerate(chain_merges(d, w, linkage)):
            seq = step * 2**40 + k
            size[b] += size[a]
            out.append((seq, int(left[a]), int(left[b]), h, size[b], made[a], made[b]))
            made[b] = seq
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MERGE.split(", ")]).astype({"left": "Int64", "right": "Int64"})

    named = rows.withColumn("last", F.coalesce("last", F.lit(-1)))
    packed = on_grid(named, own, n_bands, "c", block, pairs_of, "ca binary, cb binary, ia binary, ib binary, same boolean, raw binary")
    return packed.groupBy(F.lit("")).applyInPandas(finish, _MERGE)


def merge_steps(found: DataFrame, n: int) -> DataFrame:
    """(step, left, right, height, size, a, b): ``merges`` by rising height; points are 0..n-1, the cluster of step s is n + s."""
    steps = placed(found, ["h", "seq"], "step")
    name = steps.select("seq", (F.col("step") + n).alias("name"))
    for k, point in (("left", "a"), ("right", "b")):
        steps = steps.join(name.select(F.col("seq").alias(k), F.col("name").alias(f"_{k}")), k, "left").withColumn(f"_{k}", F.coalesce(f"_{k}", F.col(point)))
    return steps.select(F.col("step").cast("int").alias("step"), F.least("_left", "_right").cast("int").alias("left"), F.greatest("_left", "_right").cast("int").alias("right"), F.col("h").alias("height"), F.col("size").cast("long").alias("size"), "a", "b")


def roots(links: DataFrame) -> DataFrame:
    """(a, b): for each a of ``links`` (a points to b, no rings) the end of its chain, by jumping over as many links again in each round."""
    now = stored(links.select("a", "b"))
    while True:
        far = now.select(F.col("a").alias("b"), F.col("b").alias("_far"))
        after = stored(now.join(far, "b", "left").select("a", F.coalesce("_far", "b").alias("b"), F.col("_far").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return now
        now = after.select("a", "b")


def cut_labels(points: DataFrame, found: DataFrame, n: int, ks: list[int]) -> DataFrame:
    """(idx, labels): the tree cut at every k of ``ks``, clusters numbered by their first point.

    The clusters of the largest k are made by joins; what is above them, a row a cluster, is merged on the driver.
    """
    most = max(1, min(max(ks), n))
    steps = merge_steps(found, n).select("step", "a", "b")
    low = roots(steps.where(F.col("step") < n - most))
    own = points.select("idx").join(low.withColumnRenamed("a", "idx"), "idx", "left").select("idx", F.coalesce("b", "idx").alias("root"))
    first = {r["root"]: r["first"] for r in own.groupBy("root").agg(F.min("idx").alias("first")).collect()}  # ``most`` rows
    high = [(r["step"], r["a"], r["b"]) for r in steps.where(F.col("step") >= n - most).orderBy("step").collect()]
    labels: dict[int, list[int]] = {c: [] for c in first}
    for k in ks:
        up = {a: b for step, a, b in high if step < n - max(1, min(k, n))}

        def top(c: int, up=up) -> int:
            while c in up:
                c = up[c]
            return c

        ends = {c: top(c) for c in first}
        begins: dict[int, int] = {}
        for c, e in ends.items():
            begins[e] = min(begins.get(e, n), first[c])
        place = {e: i for i, e in enumerate(sorted(begins, key=begins.get))}
        for c, e in ends.items():
            labels[c].append(place[e])
    table = points.sparkSession.createDataFrame(list(labels.items()), "root long, labels array<int>")
    return own.join(F.broadcast(table) if most <= 10_000 else table, "root").select("idx", "labels")


def lightest(pairs, metric: str) -> pd.DataFrame:
    """The lightest edge out of each component (c, w, a, b, to), a < b, over mutual reachability."""
    best: dict[int, tuple] = {}
    for a, p, b, q, same in pairs:
        (ia, ca, ra), (ib, cb, rb) = ((x.rows["idx"][s], x.rows["c"][s], x.rows["core"][s]) for x, s in ((a, p), (b, q)))
        w = np.maximum(_distances(a, p, b, q, same, metric), np.maximum(ra[:, None], rb[None, :]))
        w[ca[:, None] == cb[None, :]] = np.inf
        for mine, mc, theirs, tc, m in ((ia, ca, ib, cb, w), (ib, cb, ia, ca, w.T))[: 1 if same else 2]:
            to = m.argmin(1)
            v = m[np.arange(len(mine)), to]
            rows = zip(mc.tolist(), v.tolist(), np.minimum(mine, theirs[to]).tolist(), np.maximum(mine, theirs[to]).tolist(), tc[to].tolist(), strict=True)
            for c, *edge in rows:
                if edge[0] < np.inf and (c not in best or tuple(edge) < best[c]):
                    best[c] = tuple(edge)
    return pd.DataFrame([(c, *e) for c, e in best.items()], columns=["c", "w", "a", "b", "to"])


def spanning_tree(points: DataFrame, n: int, min_samples: int, metric: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(w, a, b), the edges of the least spanning tree over mutual reachability, and (idx, core); equal edges go by (a, b)."""
    spark, near = points.sparkSession, min(min_samples, n - 1)
    width = points.select(F.size("vec").alias("d")).head()["d"]
    n_bands = bands(n, width, spark.sparkContext.defaultParallelism, block)
    own = F.pmod(F.xxhash64("idx"), F.lit(n_bands)).cast("int")

    def few(pairs) -> pd.DataFrame:
        held: dict[int, np.ndarray] = {}
        for a, p, b, q, same in pairs:
            d = np.maximum(_distances(a, p, b, q, same, metric), 0)
            for ids, m in ((a.rows["idx"][p], d), (b.rows["idx"][q], d.T))[: 1 if same else 2]:
                m = m if m.shape[1] <= near + 1 else np.partition(m, near, axis=1)[:, : near + 1]
                for i, row in zip(ids.tolist(), m, strict=True):
                    held[i] = np.sort(np.concatenate([held[i], row]))[: near + 1] if i in held else np.sort(row)
        return pd.DataFrame({"idx": list(held), "few": list(held.values())}, columns=["idx", "few"])

    found = on_grid(points.select("idx", "vec"), own, n_bands, "idx", block, few, "idx long, few array<double>")
    core = keep(found.groupBy("idx").agg(F.get(F.sort_array(F.flatten(F.collect_list("few"))), F.lit(near)).alias("core")).repartition("idx"))
    member, edges, parts = points.select("idx", F.col("idx").alias("c")), None, n
    least = F.min(F.struct("w", "a", "b", "to")).alias("m")

    while parts > 1:
        rows = points.select("idx", "vec").join(core, "idx").join(member, "idx")
        best = stored(on_grid(rows, own, n_bands, "idx", block, lambda pairs: lightest(pairs, metric), "c long, w double, a long, b long, to long").groupBy("c").agg(least).select("c", "m.*"))
        edges = best.select("w", "a", "b").distinct() if edges is None else edges.union(best.select("w", "a", "b").distinct())
        back = best.select(F.col("to").alias("c"), F.col("c").alias("to"))
        ends = best.join(back, ["c", "to"]).where("c < to").select("c")  # two that take the same edge: the smaller is the end of the chain
        up = roots(best.join(ends, "c", "left_anti").select(F.col("c").alias("a"), F.col("to").alias("b")))
        member = stored(member.join(up.withColumnRenamed("a", "c"), "c", "left").select("idx", F.coalesce("b", "c").alias("c")))
        parts = best.count() - up.count()
    return stored(edges), core


def density_of(points: DataFrame, n: int, min_size: int, min_samples: int, eps: float, metric: str, block: int = BLOCK) -> DataFrame:
    """(idx, cluster)."""
    return tree_clusters(*spanning_tree(points, n, min_samples, metric, block), n, min_size, eps)


def tree_clusters(edges: DataFrame, core: DataFrame, n: int, min_size: int, eps: float) -> DataFrame:
    """(idx, cluster). The condensed tree of a group's n - 1 edges is made by one task, which holds some numbers a point and no vectors."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        cores = pdf[pdf["b"].isna()].sort_values("a")
        links = pdf[pdf["b"].notna()].sort_values(["w", "a", "b"])
        rows = list(zip(links["w"].tolist(), links["a"].astype(int).tolist(), links["b"].astype(int).tolist(), strict=True))
        return pd.DataFrame({"idx": np.arange(n), "cluster": tree_labels(rows, cores["w"].to_numpy(), np.ones(n), min_size, eps)})

    both = edges.union(core.select(F.col("core").alias("w"), F.col("idx").alias("a"), F.lit(None).cast("long").alias("b")))
    return both.groupBy(F.lit("")).applyInPandas(tree, "idx long, cluster int")
