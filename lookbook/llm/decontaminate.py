"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are short and documents may be long, so the Jaccard similarity that banded MinHash signatures see goes to zero with
the document's length. The search is therefore for containment: items are partitioned by size (powers of two of their
number of distinct 5-word shingles), and an item's sketch is its smallest shingle hashes, as many as the size partition
calls for. A document that holds ``CONTAINED`` or more of an item misses at most (1 - ``CONTAINED``) of its shingles, so a
sketch one longer than the most that may be missing, at the partition's largest size, shares a hash with every such
document: no leak is lost, whatever the document's length. Documents whose shingle hashes meet a sketch are verified by
comparing whole shingles as strings.

All work is in DataFrame and SQL functions. The sketches are broadcast only if their counted rows are within a bound;
otherwise shingle hashes are joined by shuffle. Candidates are made distinct before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, small, unpacked

WIDTH = 5
CONTAINED = 0.8
_NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), lambda w: w != "")


def _starts(of: Column, width: int) -> Column:
    return F.when(F.size(of) >= width, F.sequence(F.lit(0), F.size(of) - width)).otherwise(F.array().cast("array<int>"))


def shingles(of: Column, width: int) -> Column:
    """Whole shingles of a word array, in text order, repeats included."""
    return F.transform(_starts(of, width), lambda i: F.concat_ws(" ", *(F.get(of, i + k) for k in range(width))))


def shingle_hashes(of: Column, width: int) -> Column:
    return F.transform(_starts(of, width), lambda i: F.xxhash64(F.lit(width), *(F.get(of, i + k) for k in range(width))))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, width, shingles, n): distinct shingles; items under five words are one shingle of their own width.

    Items without words are left out: nothing contains them. Items with equal words are searched once, under ``item``.
    """
    split = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    split = split.groupBy("w").agg(F.min("item_id").alias("item_id")).withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    whole = F.when(F.col("width") == WIDTH, shingles(F.col("w"), WIDTH)).otherwise(F.array(F.concat_ws(" ", "w")))
    hashes = F.when(F.col("width") == WIDTH, shingle_hashes(F.col("w"), WIDTH))
    for n in range(1, WIDTH):
        hashes = F.when(F.col("width") == n, shingle_hashes(F.col("w"), n)).otherwise(hashes)
    out = split.select("item_id", "width", F.array_distinct(whole).alias("shingles"), F.array_sort(F.array_distinct(hashes)).alias("hashes"))
    return out.withColumn("item", F.xxhash64("width", "hashes")).withColumn("n", F.size("shingles"))


def sketches(items: DataFrame) -> DataFrame:
    """(hash, item): the smallest hashes of each item, by the size partition [2^k, 2^(k+1)) of the item."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    length = F.floor(largest * (1 - CONTAINED) + 1e-9) + 1
    return items.select(F.explode(F.slice("hashes", 1, length.cast("int"))).alias("hash"), "item")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) where a document holds ``CONTAINED`` or more of an item.

    A row for each pair of distinct doc_id and distinct item text (named by its smallest item_id), whatever the number of
    rows that repeat it. Rows that share a doc_id are judged one by one, and the best counts. Null and empty texts hold
    nothing; rows without doc_id can't be named and give no pair; an empty table on either side gives no rows. Texts may
    be of any length; other columns, of any name, are not read.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), words(F.col("text")).alias("w"))
    return _contained(texts, benchmark).withColumnRenamed("key", "doc_id")


def _contained(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, n_shingles, n_found, containment) for the word arrays ``w`` of (key, w); of rows with equal keys the best counts."""
    items = cut(benchmark_items(benchmark))
    probes = cut(sketches(items))
    n_probes, n_shingles = probes.count(), items.agg(F.sum("n")).head()[0] or 0
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most five values
    hashes = F.concat(*(shingle_hashes(F.col("w"), n) for n in widths)) if widths else F.array().cast("array<bigint>")
    found = texts.select("key", F.explode(hashes).alias("hash")).join(small(probes, n_probes), "hash").select("key", "item").distinct()
    found = found.join(small(items.select("item", "item_id", "n", "shingles"), n_shingles), "item")
    found = cut(found.groupBy("key").agg(F.collect_list(F.struct("item_id", "n", "shingles")).alias("items")))  # at most the number of items
    n_found = found.agg(F.sum(F.aggregate("items", F.lit(1).cast("long"), lambda a, x: a + x["n"]))).head()[0] or 0
    every = F.array_distinct(F.concat(*(shingles(F.col("w"), n) for n in widths))) if widths else F.array().cast("array<string>")
    # a document's shingles are made once, whatever the number of its candidates
    judged = F.transform(F.array(every), lambda has: F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), x["n"].alias("n"), F.size(F.array_intersect(x["shingles"], has)).alias("n_found"))))
    pairs = texts.join(small(found, n_found), "key").select("key", F.inline(F.get(judged, 0)))
    pairs = pairs.groupBy("key", "item_id").agg(F.max("n").alias("n_shingles"), F.max("n_found").alias("n_found"))
    pairs = pairs.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return pairs.where(F.col("n_found") >= CONTAINED * F.col("n_shingles") - 1e-9)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Rows are judged by doc_id and text: a contaminated row without doc_id goes, and a clean row stays whatever other rows share
    its doc_id. Repeated rows go or stay together. Null and empty texts hold nothing and stay; texts may be of any
    length; all columns, of any name, stay as they are. An empty table gives none; without items nothing goes.
    """
    key = F.struct("doc_id", F.xxhash64("text")).alias("key")
    leaked = cut(_contained(docs.select(key, words(F.col("text")).alias("w")), benchmark).select("key").distinct())
    return docs.select(packed(docs), key).join(small(leaked, leaked.count()), "key", "left_anti").select(*unpacked(docs))
