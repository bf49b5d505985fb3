"""k-means of many models at once: every k and every restart is advanced by the same pass over the points.

Points are packed into blocks once and kept. A pass multiplies a block with the centres of all models that still move, and
leaves a row a centre (sum, count, cost), added up by centre on Spark; the driver holds the centres, a bounded number.
Seeding is k-means|| or a random draw. Draws are made by a hash of the vector and the model's seed: each point races with
-log(u) / weight and the smallest win, which is sampling by weight without replacement, so results don't depend on the
partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BROADCAST_CELLS
from .keep import keep

#: Points of a block, its doubles at most, and centres that a pass handles at once (with the broadcast bound on their doubles).
BLOCK, BLOCK_CELLS, MOST_CENTRES = 2000, 1_000_000, 5000
#: Rounds of k-means||, each of which draws twice k points; shifts below ``TOLERANCE`` of the mean variance end a model.
STEPS, TOLERANCE, MOST_ROUNDS = 2, 1e-4, 300


def packed(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(h, x): blocks of points as bytes, kept; h are hashes of the vectors."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = max(1, min(BLOCK, BLOCK_CELLS // max(1, len(b["x"].iloc[0])))) if len(b) else 1
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                yield pd.DataFrame({"h": [part["h"].to_numpy(np.int64).tobytes()], "x": [np.stack(part["x"]).astype(float).tobytes()]})

    rows = df.where(F.col(vec).isNotNull()).select(F.xxhash64(vec).alias("h"), F.col(vec).alias("x"))
    return keep(rows.mapInPandas(pack, "h binary, x binary"))


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1] from hashes and a seed."""
    z = h.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 1) / 2**53


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0)


def _points(batches: Iterator[pd.DataFrame], mean: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and centred points of each block."""
    for b in batches:
        for h, x in zip(b["h"], b["x"], strict=True):
            h = np.frombuffer(h, np.int64)
            yield h, np.frombuffer(x).reshape(len(h), -1) - mean


def _drawn(blocks: DataFrame, mean: np.ndarray, wanted: list[int], seeds: list[int], chosen: list[np.ndarray]) -> list[np.ndarray]:
    """For each model ``wanted`` more points, by squared distance to those ``chosen``, or evenly where there are none."""
    sent = blocks.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(np.zeros(0), np.zeros((0, len(mean))))] * len(wanted)
        for h, x in _points(batches, mean):
            for m, (n, seed, have) in enumerate(zip(wanted, seeds, sent.value, strict=True)):
                weight = squares(x, have).min(1) if len(have) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    race = np.where(weight > 1e-12, -np.log(_uniform(h, seed)) / weight, np.inf)
                race, points = np.concatenate([held[m][0], race]), np.concatenate([held[m][1], x])
                first = np.argsort(race, kind="stable")[:n]
                first = first[np.isfinite(race[first])]
                held[m] = race[first], points[first]
        for m, (race, points) in enumerate(held):
            if len(race):
                yield pd.DataFrame({"m": m, "race": race, "x": list(points)})

    rows = blocks.mapInPandas(run, "m int, race double, x array<double>")  # a task leaves as many rows as are wanted, at most
    best = rows.groupBy("m").agg(F.slice(F.array_sort(F.collect_list(F.struct("race", "x"))), 1, max(wanted)).alias("w"))
    got = {r["m"]: r["w"] for r in best.collect()}
    sent.unpersist()
    return [np.array([w["x"] for w in got.get(m, [])[:n]]).reshape(-1, len(mean)) for m, n in enumerate(wanted)]


def _advance(blocks: DataFrame, tasks: int, mean: np.ndarray, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(means, counts, cost) of the points nearest to each model's centres."""
    starts = np.cumsum([0, *(len(c) for c in centres)])
    sent = blocks.sparkSession.sparkContext.broadcast(np.concatenate(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, cost, total = np.zeros(starts[-1], np.int64), np.zeros(starts[-1]), np.zeros((starts[-1], len(mean)))
        for _, x in _points(batches, mean):
            d2, own, rows = squares(x, sent.value), np.zeros((len(x), starts[-1])), np.arange(len(x))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                to = d2[:, a:b].argmin(1)
                own[rows, a + to] = 1
                cost[a:b] += np.bincount(to, d2[rows, a + to], minlength=b - a)
            n += own.sum(0).astype(np.int64)
            total += own.T @ x
        if len(some := np.flatnonzero(n)):
            yield pd.DataFrame({"c": some, "n": n[some], "cost": cost[some], "s": list(total[some])})

    rows = blocks.mapInPandas(run, "c int, n long, cost double, s array<double>")  # a row a task and centre
    new, n, cost, total = np.concatenate(centres).copy(), np.zeros(starts[-1], np.int64), np.zeros(starts[-1]), np.zeros((starts[-1], len(mean)))
    if tasks * starts[-1] * (len(mean) + 3) > BROADCAST_CELLS:  # more than the driver takes: added up by centre first
        rows = rows.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    got = rows.toPandas()
    if len(got):
        c = got["c"].to_numpy()
        np.add.at(n, c, got["n"].to_numpy())
        np.add.at(cost, c, got["cost"].to_numpy())
        np.add.at(total, c, np.stack(got["s"]))
    new[n > 0] = total[n > 0] / n[n > 0, None]
    sent.unpersist()
    return [(new[a:b], n[a:b], float(cost[a:b].sum())) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _reduced(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of a model's weighted candidates by k-means++, fewer if they are no more."""
    points, weight = points[weight > 0], weight[weight > 0].astype(float)
    if len(points) <= k:
        return points
    rng = np.random.default_rng(seed)
    out = [int(rng.choice(len(points), p=weight / weight.sum()))]
    near = squares(points, points[out]).min(1)
    while len(out) < k and (near * weight).sum() > 0:
        out.append(int(rng.choice(len(points), p=near * weight / (near * weight).sum())))
        near = np.minimum(near, squares(points, points[out[-1:]]).min(1))
    return points[out]


def _fit(blocks: DataFrame, mean: np.ndarray, scale: float, models: list[tuple[int, str, int]]) -> list[tuple[np.ndarray, float]]:
    tasks = blocks.rdd.getNumPartitions()
    ks, seeds = [k for k, _, _ in models], [s for _, _, s in models]
    spread = [i for i, (_, init, _) in enumerate(models) if init != "random"]
    centres = _drawn(blocks, mean, [k if init == "random" else 1 for k, init, _ in models], seeds, [np.zeros((0, len(mean)))] * len(models))
    if spread:
        have = [centres[i] for i in spread]
        for step in range(STEPS):
            more = _drawn(blocks, mean, [2 * ks[i] for i in spread], [seeds[i] + 1009 * (step + 1) for i in spread], have)
            have = [np.concatenate(p) for p in zip(have, more, strict=True)]
        for i, points, (_, n, _) in zip(spread, have, _advance(blocks, tasks, mean, have), strict=True):
            centres[i] = _reduced(points, n, ks[i], seeds[i])
    cost, live = [0.0] * len(models), list(range(len(models)))
    for left in range(MOST_ROUNDS, -1, -1):
        still = []
        for i, (new, _, now) in zip(live, _advance(blocks, tasks, mean, [centres[i] for i in live]), strict=True):
            cost[i] = now
            if left and ((new - centres[i]) ** 2).sum() > TOLERANCE * scale:
                centres[i] = new
                still.append(i)
        live = still
        if not live:
            break
    return [(c + mean, v) for c, v in zip(centres, cost, strict=True)]


def fit(df: DataFrame, models: list[tuple[int, str, int]], vec: str = "vec") -> list[tuple[np.ndarray, float]]:
    """(centres, cost) of each model (k, init, seed); init is ``random`` or k-means||. No points: no centres.

    There are fewer than k centres where there are fewer different points; a centre that loses all points stays where it was.
    Models go together as far as the candidates of a pass (four times k and one) are within the bounds, and batch by batch beyond.
    """
    blocks = packed(df, vec)
    found = df.where(F.col(vec).isNotNull()).select(array_to_vector(vec).alias("v")).groupBy(F.lit("")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").head()
    if found is None:
        return [(np.zeros((0, 0)), 0.0) for _ in models]
    mean, scale = found["mean"].toArray(), float(found["variance"].toArray().mean())
    most, out, now = min(MOST_CENTRES, BROADCAST_CELLS // max(1, len(mean))), [], []
    for model in models:
        if now and sum(4 * k + 1 for k, _, _ in [*now, model]) > most:
            out += _fit(blocks, mean, scale, now)
            now = []
        now.append(model)
    out += _fit(blocks, mean, scale, now) if now else []
    blocks.unpersist()
    return out
