"""Mixing sources to target weights by a low-discrepancy source schedule.

The mix is a row of slots, one block of ``block`` words each. Slot i is given the i-th van der Corput point, the reversed
bits of i, out of 2^k; points are mapped through the cumulative weights, counted in blocks, to a source. Slots are ranked
per source, and rank r of a source takes block r of it. Over a whole period of 2^k the points are all the multiples of
1 / 2^k, so a source owns as many slots as it has blocks to give, and any stretch of slots holds it in proportion. Points
beyond the sum of the weights own nothing; their slots are skipped. What no slot takes isn't in the mix.

A source's blocks are cut from the stream of its documents in shuffled order, shuffled anew for each pass over the source
(at most three passes, as a target is at most three times the source); the last block ends at the target.

Ranks and running sums of a source with a third of all rows are made in three steps: sums of small runs of slots (or of
ranges of the shuffled order) and of spans of runs, summed up over the spans, then over the runs of a span, then within a
run. No source meets in one task: the longest sort is over a source's spans, a row per ``RUN * SPAN`` blocks.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, packed, small, unpacked

MAX_REPEATS = 3
BLOCK_WORDS = 1024
#: Blocks in a run: small enough that the runs of a source with a third of all rows keep many tasks busy.
RUN = 1 << 6
#: Runs in a span.
SPAN = 1 << 10


def word_counts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, more...): size is the number of words, 0 for a null text."""
    return docs.select("doc_id", "source", *more, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): a row a source.

    Weights 1, 2, 3 repeat over the sources in code-point order, null last. Targets share all words by weight, but stop at
    ``MAX_REPEATS`` times the source; the excess is shared again by weight. Sorted by limit per weight, the stopped sources
    come first, so one running sum finds the level at which the rest stands.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = by.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    limit = (F.col("source_size") * MAX_REPEATS).cast("double")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), zero)
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
    out = weighed.withColumn("level", level).withColumn("open", limit / F.col("weight") > F.col("level"))
    first = F.min(F.when(F.col("open"), limit / F.col("weight"))).over(every)
    # of those still open the first has the final level
    stand = F.max(F.when(F.col("open") & (limit / F.col("weight") == F.col("first")), F.col("level"))).over(every)
    out = out.withColumn("first", first).withColumn("stand", stand)
    out = out.withColumn("target", F.when(F.col("open"), F.col("weight") * F.col("stand")).otherwise(limit))
    return out.select("source", "source_size", "target")


def _numbered(rows: DataFrame, order: str, amount: str) -> DataFrame:
    """``rows`` with ``start``, the sum of ``amount`` over the source's rows before this one in the order of (turn, run, order)."""

    def ahead(within: list[str], by: list[str], what: str) -> Column:
        return F.coalesce(F.sum(what).over(Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    run, span = ["sid", "turn", "run"], ["sid", "turn", "span"]
    runs = rows.groupBy(run).agg(F.sum(amount).alias("in_run")).withColumn("span", F.floor(F.col("run") / SPAN))
    spans = runs.groupBy(span).agg(F.sum("in_run").alias("in_span"))
    spans = spans.select(*span, ahead(["sid"], ["turn", "span"], "in_span").alias("to_span"))
    runs = runs.withColumn("to_run", ahead(span, ["run"], "in_run")).join(spans, span).select(*run, (F.col("to_span") + F.col("to_run")).alias("to_run"))
    inside = rows.withColumn("start", ahead(run, [order, "rid"], amount))
    return inside.join(runs, run).withColumn("start", F.col("start") + F.col("to_run")).drop("to_run")


def radical_inverse(slot: Column, bits: int) -> Column:
    """The van der Corput point of ``slot`` times 2^bits: its lowest ``bits`` bits in reverse order."""
    # by digits: the usual swaps of masked bits name the slot twice in each of six steps, so 64 times in all, wherever a plan has the point
    return F.conv(F.rpad(F.reverse(F.bin(slot)), bits, "0"), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, sid, block): the slots that a source owns and the block of the source that each takes.

    ``goals``: (sid, target), a row a source. A source weighs as many blocks as its rounded target fills, the last one in part.
    """
    spark, upto = goals.sparkSession, Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = goals.select("sid", F.ceil(F.round("target") / block_words).alias("blocks")).where("blocks > 0")
    weighed = cut(weighed.withColumn("high", F.sum("blocks").over(upto)).withColumn("low", F.col("high") - F.col("blocks")))
    known = weighed.agg(F.max("high"), F.count("*")).head()
    n, n_sources = known[0] or 0, known[1]
    bits = max(n - 1, 0).bit_length()
    # points meet the sources by cells of the cumulative weights
    width = max(1, n // (4 * max(n_sources, 1)))
    spans = weighed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    slots = spark.range(1 << bits if n else 0).select(F.col("id").alias("slot"), radical_inverse(F.col("id"), bits).alias("point")).where(F.col("point") < n)
    owned = slots.withColumn("cell", F.floor(F.col("point") / width)).join(small(spans.select("cell", "low", "high", "sid"), 6 * n_sources), "cell").where("point >= low and point < high")
    owned = owned.select("slot", "sid", F.lit(1).alias("one"), F.col("slot").alias("rid"), F.lit(0).alias("turn"), F.floor(F.col("slot") / RUN).alias("run"))
    return _numbered(owned, "slot", "one").select("slot", "sid", F.col("start").alias("block"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The documents with their rows' ids and targets, and the pieces of the mix.

    First: (rid, doc_id, size, source_size, target). Second: (slot, sid, block, rid, words), a row for each piece of a document
    that a block holds; slots in order are the mix. No document is used more than three times, and reruns agree: order
    follows from hashes of the ids. Rows that repeat an id are documents of their own; null texts have size 0 and no piece;
    a null source is a source; an empty table gives empty results.
    """
    sized = cut(word_counts(docs).withColumn("rid", F.monotonically_increasing_id()))
    return _mixed(sized, block_words)


def _mixed(sized: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``mix`` of (rid, doc_id, source, size)."""
    goals = cut(targets(sized).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    known = goals.agg(F.sum("source_size"), F.count("*")).head()
    total, n_sources = known[0] or 0, known[1]
    named = sized.join(small(goals, n_sources), sized["source"].eqNullSafe(goals["source"])).select("rid", "doc_id", "sid", "size", "source_size", "target")

    # documents in each pass, in shuffled order
    passes = F.ceil(F.round("target") / F.greatest("source_size", F.lit(1))).cast("int")
    streams = named.where("size > 0 and round(target) > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), passes - 1)))
    streams = streams.withColumn("mark", F.xxhash64("doc_id", "size", "turn"))
    runs = max(1, ceil(total / block / RUN))
    streams = streams.withColumn("run", F.pmod("mark", F.lit(runs)))
    placed = _numbered(streams, "mark", "size")
    end = F.least(F.col("start") + F.col("size"), F.round("target").cast("long"))
    placed = placed.withColumn("end", end).where("start < end")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    words = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    # cut: each half of the join is planned by itself, and the driver holds no plan of all steps
    pieces = cut(pieces.select("sid", "block", "rid", words.alias("words")))
    return named, pieces.join(cut(schedule(goals, block)), ["sid", "block"]).select("slot", "sid", "block", "rid", "words")


def _taken(named: DataFrame, pieces: DataFrame) -> DataFrame:
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_blocks"))
    zero = F.lit(0)
    return named.join(taken, "rid", "left").select("rid", "doc_id", "size", "source_size", "target", F.coalesce("taken", zero).cast("long").alias("taken"), "first_slot", F.coalesce("n_blocks", zero).cast("long").alias("n_blocks"))


def mixed_sizes(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_blocks) for each row of ``docs``.

    taken: the words that the mix takes of it, repeats counted, in n_blocks blocks, the first at first_slot (null if none).
    Null, empty and wordless texts have size 0 and nothing taken; texts may be of any length. Repeated rows and ids are documents of
    their own, a null source is a source, columns besides doc_id, source and text are not read; an empty table gives no rows.
    """
    return _taken(*mix(docs, block_words)).drop("rid")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the further columns of ``mixed_sizes``, which replace columns of the same names.

    Sizes and texts meet again by two hashes of the whole row (but for maps), so texts are shuffled once and stored nowhere. Rows
    that are equal in all columns are interchangeable: one of them is read for all. For null, empty and very long texts, null ids and
    sources and empty tables see ``mixed_sizes``.
    """
    new = ["size", "source_size", "target", "taken", "first_slot", "n_blocks"]
    docs = docs.drop(*new)
    hashed = [F.col(c) for c, kind in docs.dtypes if kind != "void" and "map<" not in kind and kind != "variant"]
    rows = docs.select("doc_id", "source", "text", packed(docs), F.xxhash64(F.lit(1), *hashed).alias("h1"), F.xxhash64(F.lit(2), *hashed).alias("h2"))
    key = ["h1", "h2"]
    sized = cut(word_counts(rows, *key).withColumn("rid", F.monotonically_increasing_id()))
    found = cut(_taken(*_mixed(sized, block_words)).join(sized.select("rid", *key), "rid").select(*key, *new))
    again = cut(sized.groupBy(*key).count().where("count > 1").select(*key))
    rows = rows.select(*key, "row")
    if (n := again.count()) > 0:
        once = rows.join(small(again, n), key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
        rows = rows.join(small(again, n), key, "left_anti").union(once)
    return found.join(rows, key).select(*unpacked(docs), *new)
