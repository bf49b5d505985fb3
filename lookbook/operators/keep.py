"""Tables that are read more than once are kept by executors, in memory or on disk, until ``release``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """``df``, persisted. Results are lazy, so it can't be let go when an operator returns; see ``release``."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[-1]


def release() -> int:
    """Let go of all tables that operators have kept so far, once their results are written; the number of them."""
    n = len(_KEPT)
    while _KEPT:
        _KEPT.pop().unpersist()
    return n


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; in local mode, where there is one machine, one of our own if it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lookbook-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder: a table that rounds hand on, without the rounds that made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder. Unlike a checkpoint it takes nothing along that the planner knew of ``df``,
    which would grow from round to round."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
