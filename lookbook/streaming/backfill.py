"""Incremental feature backfill: compute features only for stems that the cache lacks.

A cache that grows is a Parquet table in buckets of the key's hash, a folder each. A batch reads the keys of the buckets that
its own keys fall in and no others, so a small batch doesn't read the whole cache. Each batch writes its rows in folders of its
own, named by its id: a batch that is played again after a failure replaces what it had written, and adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def missing(images: DataFrame, cache: DataFrame, key: str = "stem") -> DataFrame:
    return images.join(cache.select(key).distinct(), key, "left_anti")


def backfill(images: DataFrame, cache: DataFrame, featurise: Callable[[DataFrame], DataFrame], key: str = "stem") -> DataFrame:
    """The cache with the features of all missing stems added, one row a stem."""
    return cache.unionByName(featurise(missing(images, cache, key).dropDuplicates([key])))


def _in_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def write_cache(rows: DataFrame, path: str, batch: str, key: str = "stem", buckets: int = BUCKETS) -> None:
    """Writes ``rows`` to the cache in ``path`` as those of ``batch``, in place of what the batch has written before."""
    named = _in_buckets(rows, key, buckets).withColumn("_batch", F.lit(batch))
    named.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table in ``path``, or None where nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_cache(spark: SparkSession, path: str, buckets: list[int] | None = None, but: str | None = None) -> DataFrame | None:
    """The rows of the cache, of ``buckets`` only and without those of batch ``but``; None where nothing has been written."""
    whole = _stored(spark, path)
    if whole is None or "_bucket" not in whole.columns:
        return whole
    whole = whole if buckets is None else whole.where(F.col("_bucket").isin(*buckets))
    whole = whole if but is None else whole.where(F.col("_batch").cast("string") != but)
    return whole.drop("_bucket", "_batch")


def top_up(batch: DataFrame, path: str, batch_id: str, featurise: Callable[[DataFrame], DataFrame], key: str = "stem", buckets: int = BUCKETS) -> None:
    """Adds to the cache in ``path`` the features of the keys of ``batch`` that it lacks. Null keys are left out.

    A cache that was written without buckets stays as it is: it is read whole and appended to.
    """
    spark = batch.sparkSession
    cache, rows = _stored(spark, path), batch.where(F.col(key).isNotNull())
    if cache is not None and "_bucket" not in cache.columns:
        featurise(missing(rows, cache, key).dropDuplicates([key])).select(cache.columns).write.mode("append").parquet(path)
        return
    rows = _in_buckets(rows, key, buckets).persist()
    met = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
    if met:
        known, images = read_cache(spark, path, met, batch_id), rows.drop("_bucket")
        new = images if known is None else missing(images, known, key)
        write_cache(featurise(new.dropDuplicates([key])), path, batch_id, key, buckets)
    rows.unpersist()


def backfill_stream(spark: SparkSession, source: str, schema: str, cache_path: str, checkpoint: str, featurise: Callable[[DataFrame], DataFrame], key: str = "stem", buckets: int = BUCKETS) -> None:
    """``top_up`` over files that arrive in ``source``: handles what is there, then stops."""
    stream = spark.readStream.schema(schema).parquet(source)
    each = stream.writeStream.foreachBatch(lambda batch, i: top_up(batch, cache_path, f"stream-{i}", featurise, key, buckets))
    each.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
