"""Exact hierarchies by nearest-neighbour lists (``lists``) of a group that one task can't search.

Clusters are a table of blocks in the shared folder: names, mean vectors, sizes and lists as bytes. In a pass the clusters
whose lists have run out are dealt over tasks and meet all blocks, which no shuffle copies; one task then makes the merges that the lists
settle, and leaves the blocks of the next pass. That task holds the mean vectors and some numbers a cluster, and no distances; small
searches it does itself. Groups of over ``MOST_CELLS`` doubles go by the rounds of ``rounds``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keep import stored
from .lists import LISTED, Clusters, Search, start

#: Doubles of a group's vectors that one task takes; rows of a block; pairs that the merging task searches by itself.
MOST_CELLS, BLOCK, NEAR_PAIRS = 16_000_000, 4096, 250_000_000

_STATE = "kind string, n long, stale long, names binary, x binary, w binary, last binary, top binary, bound binary, near binary, gap binary"
_ARROW = pa.schema([("kind", pa.string()), ("n", pa.int64()), ("stale", pa.int64()), *((k, pa.binary()) for k in ("names", "x", "w", "last", "top", "bound", "near", "gap"))])
_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]
_KINDS = {"names": np.int64, "x": float, "w": float, "last": np.int64, "top": float, "bound": float, "near": np.int64, "gap": float}


def _rows(kind: str, stale: np.ndarray, **arrays: np.ndarray) -> Iterator[list]:
    """Rows of ``_STATE`` of up to ``BLOCK`` clusters each."""
    for at in range(0, len(stale), BLOCK):
        part = {k: np.ascontiguousarray(v[at : at + BLOCK], dtype=_KINDS[k]).tobytes() for k, v in arrays.items()}
        yield [kind, len(stale[at : at + BLOCK]), int(stale[at : at + BLOCK].sum()), *(part.get(k) for k in _KINDS)]


def _batch(*rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, r, strict=True)) for r in rows], _ARROW)


def _parts(rows: pa.RecordBatch, k: str, wide: bool = False) -> list[np.ndarray]:
    """The arrays of column ``k``, a row each, in place."""
    return [np.frombuffer(v.as_buffer(), _KINDS[k]).reshape((n, -1) if wide else -1) for v, n in zip(rows.column(k), rows.column("n").to_pylist(), strict=True)]


def _first_blocks(points: DataFrame, metric: str) -> DataFrame:
    """The blocks of single points, copies of a vector being one cluster."""
    mean = None
    if metric != "cosine":
        mean = points.select(array_to_vector("vec").alias("v")).agg(Summarizer.mean(F.col("v")).alias("m")).head()["m"].toArray()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["vec"]).astype(float)
                x, n = start(x, metric) if mean is None else x - mean, b["n"].to_numpy(float)
                more = {"last": np.where(n > 1, b["last"], -1), "top": np.zeros(len(b)), "bound": np.full(len(b), -np.inf), "near": np.full((len(b), LISTED), -1), "gap": np.full((len(b), LISTED), np.inf)}
                yield pd.DataFrame(_rows("state", np.ones(len(b), bool), names=b["idx"].to_numpy(), x=x, w=n, **more), columns=_COLUMNS)

    return points.groupBy("vec").agg(F.min("idx").alias("idx"), F.max("idx").alias("last"), F.count("*").alias("n")).mapInPandas(pack, _STATE)


def _copied(points: DataFrame) -> DataFrame:
    """The merges of copies of a vector: each, named by its point, goes up in the first."""
    w = Window.partitionBy("vec").orderBy("idx")
    placed = points.select("idx", F.row_number().over(w).alias("place"), F.first("idx").over(w).alias("b"), F.lag("idx").over(w).alias("before"))
    right = F.when(F.col("place") > 2, F.col("before"))
    return placed.where("place > 1").select(F.col("idx").alias("seq"), F.col("idx").alias("a"), "b", F.lit(0.0).alias("h"), F.col("place").cast("double").alias("size"), F.lit(None).cast("long").alias("left"), right.alias("right"))


def _searched(state: DataFrame, stale: int, metric: str) -> DataFrame:
    """Rows of ``_STATE`` with new lists, for clusters whose lists have run out."""
    tasks = 3 * state.sparkSession.sparkContext.defaultParallelism
    size = max(64, -(-stale // (tasks * -(-stale // (tasks * BLOCK)))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for names, x, w, gap, bound in zip(*(_parts(b, k, k in ("x", "gap")) for k in ("names", "x", "w", "gap", "bound")), strict=True):
                out = gap.min(1) > bound
                held.append((names[out], x[out], w[out]))
                while sum(len(h[0]) for h in held) >= size:
                    names, x, w = map(np.concatenate, zip(*held, strict=True))
                    yield block(names[:size], x[:size], w[:size])
                    held = [(names[size:], x[size:], w[size:])]
        if sum(len(h[0]) for h in held):
            yield block(*map(np.concatenate, zip(*held, strict=True)))

    def block(*arrays: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["s", "sx", "sw"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, None
        for b in batches:
            columns = [b.column(k) for k in ("s", "sx", "sw", "names", "x", "w")]
            for at in range(b.num_rows):
                s, sx, sw, names, x, w = (c[at].as_buffer() for c in columns)
                if now is None or not s.equals(now):
                    if found is not None:
                        yield of(found)
                    now, ids = pa.py_buffer(s.to_pybytes()), np.frombuffer(s, np.int64).copy()
                    found = Search(ids, np.frombuffer(sx).reshape(len(ids), -1), np.frombuffer(sw), metric)
                ids = np.frombuffer(names, np.int64)
                found.meet(ids, np.frombuffer(x).reshape(len(ids), -1), np.frombuffer(w))
        if found is not None:
            yield of(found)

    def of(found: Search) -> pa.RecordBatch:
        return _batch(*_rows("found", np.zeros(len(found.ids), bool), names=found.ids, near=found.near, gap=found.gap))

    some = state.where("stale > 0").mapInArrow(pick, "s binary, sx binary, sw binary").repartition(tasks)
    return some.hint("shuffle_replicate_nl").crossJoin(state.select("names", "x", "w")).mapInArrow(meet, _STATE)


def merges_by_lists(points: DataFrame, metric: str) -> DataFrame:
    """``rounds.merges`` of Ward (euclidean) or average cosine distances."""
    state, out, step = stored(_first_blocks(points, metric)), [stored(_copied(points))], 1

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        found: dict[str, list[np.ndarray]] = {"names": [], "near": [], "gap": []}
        done = 0
        for b in batches:
            for at, (kind, n) in enumerate(zip(b.column("kind").to_pylist(), b.column("n").to_pylist(), strict=True)):
                row = b.slice(at, 1)
                if kind == "found":
                    for k, parts in found.items():
                        parts.append(_parts(row, k, k != "names")[0].copy())
                    continue
                for k in _KINDS:
                    part = _parts(row, k, k in ("x", "near", "gap"))[0]
                    if k not in held:
                        held[k] = np.empty((total, *part.shape[1:]), _KINDS[k])
                    held[k][done : done + n] = part
                done += n
            del b
        if not held:
            return
        order = np.argsort(held["names"])
        have = Clusters(held.pop("names")[order], held.pop("x")[order], held.pop("w")[order], metric)
        place = lambda ids: np.where(ids >= 0, np.searchsorted(have.names, ids), -1)
        for k in ("last", "top", "bound", "gap"):
            setattr(have, k, held.pop(k)[order])
        have.near = place(held.pop("near")[order])
        at, near, gap = (np.concatenate(found.pop(k)) for k in ("names", "near", "gap"))
        at, near = place(at), place(near)
        at, of = np.unique(at, return_inverse=True)  # a cluster has a list from each part of the table that it has met
        row, by = np.repeat(of, LISTED), gap.ravel()
        first = np.lexsort((by, row))
        nth = np.arange(len(first)) - np.searchsorted(row[first], np.arange(len(at)))[row[first]]
        first = first[nth < LISTED]
        have.listed(at, near.ravel()[first].reshape(-1, LISTED), by[first].reshape(-1, LISTED))
        seq = have.settle(step * 2**40)
        while len(have.names) > 1 and len(have.stale()) * len(have.names) <= NEAR_PAIRS:
            have.search()
            seq = have.settle(seq)
        stale = np.zeros(len(have.names), bool)
        stale[have.stale()] = True
        for m in have.merged:
            yield _batch(["merged", len(m[0]), 0, None, np.stack(m).astype(float).tobytes(), *[None] * 6])
        if len(have.names) > 1:
            named = np.where(have.near >= 0, have.names[have.near], -1)
            yield from map(_batch, _rows("state", stale, **{k: getattr(have, k) for k in _KINDS if k != "near"}, near=named))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["x"]:
                seq, p, q, h, size, left, right = np.frombuffer(x).reshape(7, -1)
                table = pd.DataFrame({"seq": seq.astype(np.int64), "a": p.astype(np.int64), "b": q.astype(np.int64), "h": h, "size": size, "left": left, "right": right})
                yield table.astype({"left": "Int64", "right": "Int64"}).assign(left=lambda t: t["left"].where(t["left"] >= 0), right=lambda t: t["right"].where(t["right"] >= 0))

    while True:
        known = state.where("kind = 'state'").agg(F.sum("n").alias("n"), F.sum("stale").alias("stale")).head()  # blocks are summed up
        if (known["n"] or 0) <= 1:
            break
        blocks, total = state.where("kind = 'state'"), known["n"]
        state = stored(blocks.union(_searched(blocks, known["stale"], metric)).repartition(1).mapInArrow(settle, _STATE))
        out.append(state.where("kind = 'merged'").select("x").mapInPandas(merged, "seq long, a long, b long, h double, size double, left long, right long"))
        step += 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return stored(whole)
