"""Shared pieces of the training-data operators: checkpoints and joins by a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in the base contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids (or array elements) sent to every executor at most (8 bytes each, some 30 MB as a hash table); beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. In local mode, where there is one machine, a folder of our own if it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lookbook-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, for rows with whole texts: a Parquet table in the shared folder, compressed and read by columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> Column:
    """The columns of ``docs`` as one struct ``row``, out of the way of an operator's own names; void columns hold nothing."""
    return F.struct(*(F.col(c) for c, kind in docs.dtypes if kind != "void")).alias("row")


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` from ``row``, but for those that ``changed`` replaces (only names that ``docs`` has)."""
    kinds = dict(docs.dtypes)
    return [(changed[c] if c in changed else F.lit(None) if kinds[c] == "void" else F.col("row")[c]).alias(c) for c in docs.columns]


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its counted size with the elements of its arrays, is within the bound; else unmarked."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
