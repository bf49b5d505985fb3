"""Batch scoring with a model that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NO_OUTPUT = "no output"


def score_rows(df: DataFrame, key: str, value: str, make_model: Callable[[], Callable[[list], list]], batch_size: int = 16) -> DataFrame:
    """(key, vec, error): the model's output for each row, or why there is none. ``make_model`` runs once a task and returns a function over a batch.

    A batch that fails is tried row by row, so that other rows of it stay; a row that fails keeps its key and the error's text,
    one for which the model returns None has the error ``no output``. Being out of memory fails the task, and so does a model of which all rows of a
    task fail, if they are over ``batch_size``: that is no matter of rows.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, good, bad = make_model(), 0, ""
        failed = 0
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                values = part[value].tolist()
                try:
                    out = [_told(v) for v in model(values)]
                    if len(out) != len(values):
                        raise ValueError(f"{len(out)} outputs for {len(values)} rows")
                except MemoryError:
                    raise
                except Exception:  # told apart row by row
                    out = [_one(model, x) for x in values]
                good += sum(e is None for _, e in out)
                failed += sum(e is not None for _, e in out)
                bad = next((e for _, e in out if e is not None), bad)
                yield pd.DataFrame({"key": part[key].to_numpy(), "vec": [v for v, _ in out], "error": [e for _, e in out]})
        if failed > batch_size and not good and bad != NO_OUTPUT:
            raise RuntimeError(f"the model failed on all {failed} rows of a task: {bad}")

    return df.select(key, value).mapInPandas(run, f"key {kind}, vec array<double>, error string")


def batch_score(df: DataFrame, key: str, value: str, make_model: Callable[[], Callable[[list], list]], batch_size: int = 16) -> DataFrame:
    """(key, vec) of the rows that ``score_rows`` has an output for; its ``error`` tells of the others."""
    return score_rows(df, key, value, make_model, batch_size).where("error is null").select("key", "vec")


def _told(v: object) -> tuple[np.ndarray | None, str | None]:
    return (None, NO_OUTPUT) if v is None else (np.asarray(v, float), None)


def _one(model: Callable[[list], list], x: object) -> tuple[np.ndarray | None, str | None]:
    try:
        return _told(next(iter(model([x]))))
    except MemoryError:
        raise
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"
