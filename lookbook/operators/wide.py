"""Principal components of very wide vectors, without a matrix of width x width.

With few vectors (up to ``GRAM_ROWS``) the components follow from the products of all pairs of vectors, made by pairs of bands.
With more, a random subspace is turned towards them by passes over the points: a task leaves one width x n sum, and
the driver makes it orthogonal again, until the variances that it holds no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keep import keep

#: Vectors up to which all products fit the driver (128 MB), doubles of a band, of a piece of a sum and of a block.
GRAM_ROWS, BAND_CELLS, PIECE_CELLS, BLOCK_CELLS = 4096, 8_000_000, 250_000, 1_000_000
#: Dimensions of the subspace besides the wanted ones, passes at most, and the relative change of variances that ends them.
MORE, MOST_PASSES, TOLERANCE = 24, 60, 1e-10


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices that come as (piece, x), flat pieces of ``PIECE_CELLS`` doubles; added up by piece on Spark."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "x": [sum(np.frombuffer(x) for x in pdf["x"]).tobytes()]})

    out = np.zeros(shape[0] * shape[1])
    for r in parts.groupBy("piece").applyInPandas(add, "piece int, x binary").toLocalIterator():  # shape in all
        x = np.frombuffer(r["x"])
        out[r["piece"] * PIECE_CELLS : r["piece"] * PIECE_CELLS + len(x)] = x
    return out.reshape(shape)


def _pieces(x: np.ndarray) -> pd.DataFrame:
    flat = np.ascontiguousarray(x).reshape(-1)
    places = range(0, len(flat), PIECE_CELLS)
    return pd.DataFrame({"piece": np.arange(len(places), dtype=np.int32), "x": [flat[a : a + PIECE_CELLS].tobytes() for a in places]})


def _blocks(df: DataFrame, vec: str) -> tuple[DataFrame, int, int]:
    """(place, x): kept blocks of vectors as bytes, numbered from ``place`` on; the number of vectors and their width."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = max(1, BLOCK_CELLS // max(1, len(b["x"].iloc[0]))) if len(b) else 1
            for at in range(0, len(b), size):
                x = np.stack(b["x"].iloc[at : at + size]).astype(float)
                yield pd.DataFrame({"n": [len(x)], "width": [x.shape[1]], "x": [x.tobytes()]})

    rows = keep(df.where(F.col(vec).isNotNull()).select(F.col(vec).alias("x")).mapInPandas(pack, "n int, width int, x binary").withColumn("id", F.monotonically_increasing_id()))
    found = rows.agg(F.sum("n"), F.max("width")).head()
    return rows, found[0] or 0, found[1] or 0


def _sweep(rows: DataFrame, width: int, run, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``run(block)`` over all blocks, each a matrix of ``shape``."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b["x"]:
                part = run(np.frombuffer(x).reshape(-1, width))
                total = part if total is None else total + part
        if total is not None:
            yield _pieces(total)

    return _summed(rows.select("x").mapInPandas(task, "piece int, x binary"), shape)


def _gram(rows: DataFrame, n: int, width: int, mean: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """Products of all pairs of centred vectors, and where each block's rows begin."""
    sizes = rows.select("id", "n").orderBy("id").collect()  # a row a block of a group that fits
    starts = dict(zip([r["id"] for r in sizes], np.cumsum([0, *(r["n"] for r in sizes)])[:-1].tolist(), strict=True))
    parts = max(1, min(len(sizes), -(-n * width // BAND_CELLS)))
    sent = rows.sparkSession.sparkContext.broadcast((starts, mean))

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        first, middle = sent.value
        x = {r.id: np.frombuffer(r.x).reshape(-1, width) - middle for r in pdf.itertuples()}
        band, (i, j) = dict(zip(pdf["id"], pdf["own"], strict=True)), (pdf["i"].iloc[0], pdf["j"].iloc[0])
        out = [(first[a], first[b], x[a] @ x[b].T) for a in x for b in x if band[a] == i and band[b] == j and (i != j or a <= b)]
        return pd.DataFrame([(a, b, *g.shape, g.tobytes()) for a, b, g in out], columns=["a", "b", "p", "q", "x"])

    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select("id", "x", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    products = dealt.repartition(parts * (parts + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(pair, "a int, b int, p int, q int, x binary")
    gram = np.zeros((n, n))
    for r in products.toLocalIterator():
        g = np.frombuffer(r["x"]).reshape(r["p"], r["q"])
        gram[r["a"] : r["a"] + r["p"], r["b"] : r["b"] + r["q"]] = g
        gram[r["b"] : r["b"] + r["q"], r["a"] : r["a"] + r["p"]] = g.T
    return gram, starts


def components(df: DataFrame, n: int, vec: str = "vec", seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(width x n components, their mean): at most as many as there are vectors; those without variance are zero."""
    rows, count, width = _blocks(df, vec)
    if not count:
        return np.zeros((width, n)), np.zeros(width)
    mean = _sweep(rows, width, lambda x: x.sum(0)[None, :], (1, width))[0] / count
    if count <= GRAM_ROWS:
        gram, starts = _gram(rows, count, width, mean)
        value, vector = np.linalg.eigh(gram)
        value, vector = value[::-1][:n], vector[:, ::-1][:, :n]
        scale = np.where(value > 1e-12 * max(value[0], 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0)
        weights = rows.sparkSession.sparkContext.broadcast((starts, vector * scale))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                for i, x in zip(b["id"], b["x"], strict=True):
                    x = np.frombuffer(x).reshape(-1, width) - mean
                    part = x.T @ weights.value[1][weights.value[0][i] : weights.value[0][i] + len(x)]
                    total = part if total is None else total + part
            if total is not None:
                yield _pieces(total)

        found = _summed(rows.select("id", "x").mapInPandas(task, "piece int, x binary"), (width, len(value)))
    else:
        size, last = min(width, n + MORE), None
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
        for _ in range(MOST_PASSES):
            sent = rows.sparkSession.sparkContext.broadcast(basis)
            turned = _sweep(rows, width, lambda x, s=sent: (x - mean).T @ ((x - mean) @ s.value), (width, size))
            value, vector = np.linalg.eigh((basis.T @ turned + turned.T @ basis) / 2)
            value, found = value[::-1][:n], (basis @ vector)[:, ::-1][:, :n]
            sent.unpersist()
            if last is not None and np.abs(value - last).max() <= TOLERANCE * max(value[0], 1e-300):
                break
            last, basis = value, np.linalg.qr(turned)[0]
    rows.unpersist()
    return np.pad(found, ((0, 0), (0, n - found.shape[1]))), mean


def project(df: DataFrame, n: int, vec: str = "vec") -> DataFrame:
    """``df`` with ``vec`` in the first ``n`` principal components, centred only where they are found; a null vector stays null."""
    sent = df.sparkSession.sparkContext.broadcast(components(df, n, vec)[0])

    def turn(vectors: pd.Series) -> pd.Series:
        some = vectors.notna()
        if not some.any():
            return pd.Series([None] * len(vectors))
        return pd.Series(list(np.stack(vectors[some]).astype(float) @ sent.value), index=vectors.index[some]).reindex(vectors.index, fill_value=None)

    return df.withColumn(vec, F.pandas_udf(turn, "array<double>")(vec))
