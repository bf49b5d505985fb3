"""Substring dedup by hashing lines, paragraphs or the sentences of lines.

Units are cut, normalised (A-Z lower-cased, blanks collapsed) and digested. Digests are grouped globally; of each group the
earliest ranked occurrence, by (doc_id, text hash, place), stays and the others are repeated units. A repeated unit is
removed where it and its neighbours form a passage: repeated units in a row of ``min_words`` words or more together. All
offsets are those of the original text.

A line may hold a passage that others hold as well between words of its own, so by default lines are cut at their
sentence ends. Units under ``least`` words are no evidence by themselves: they aren't digested, and go only with a passage
that has them inside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, small, unpacked
from .text_pieces import between, chunks, let

#: Words of a passage. Half of 50: a passage of 50 words that begins and ends inside sentences has whole ones in between only.
MIN_WORDS = 25
#: Words of a unit that is digested.
LEAST = 3
#: Where units end, with the separator.
_ENDS = {"sentence": re.compile(r"[.!?]+[ \t\r]+|\n"), "line": re.compile("\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}


def cut_units(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """Start and end (exclusive) of each unit in code points; a unit ends after its separator, so units cover the text."""
    at = 0
    for m in _ENDS[unit].finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _mark():
    """What tells documents apart: rows of equal doc_id and text are one document."""
    return F.xxhash64("text").alias("mark")


def digest_units(docs: DataFrame, unit: str = "sentence", least: int = LEAST) -> DataFrame:
    """(doc_id, mark, place, start, end, words, digest) of units with ``least`` words or more; place counts these in a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, mark, text in zip(b["doc_id"].astype("Int64"), b["mark"], b["text"], strict=True):
                place = 0
                for s, e in cut_units(text, unit):
                    words = text[s:e].encode().lower().split()
                    if len(words) >= least:
                        rows.append((doc, mark, place, s, e, len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest()))
                        place += 1
            yield pd.DataFrame(rows, columns=["doc_id", "mark", "place", "start", "end", "words", "digest"]).astype({"doc_id": "Int64"})

    named = docs.where("text is not null").select("doc_id", _mark(), "text")
    return named.mapInPandas(run, "doc_id long, mark long, place int, start int, end int, words int, digest binary")


def repeated_units(docs: DataFrame, unit: str = "sentence", least: int = LEAST) -> DataFrame:
    """(doc_id, mark, place, start, end, words, kept): units that are not the earliest of their digest, and that one.

    ``kept`` is (no_id, doc_id, mark, place) of the occurrence that stays. Equal units within one document count as well.
    Null and empty texts have no units. Rows of equal doc_id and text are one document, so they never repeat each other;
    rows of equal doc_id and other texts are documents of their own. Rows without doc_id rank last. An empty table gives none.
    """
    units = cut(digest_units(docs, unit, least))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "place")
    groups = units.groupBy("digest").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    # repeated digests grow with the corpus, so they are never sent to all tasks; adaptive execution splits a hot digest
    return units.join(groups, "digest").where(rank != F.col("kept")).drop("digest").distinct()


def passages(repeated: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, gone): the spans to remove of each document in order, as (start, end, kept_doc_id, kept_place).

    Repeated units in a row with ``min_words`` words or more together are a span, named by what stays of its first unit.
    A document's own units meet in one task, no more.
    """
    of = ["doc_id", "mark"]
    run = F.col("place") - F.row_number().over(Window.partitionBy(*of).orderBy("place"))
    first = F.min_by(F.struct(F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.place").alias("kept_place")), "place").alias("kept")
    spans = repeated.withColumn("run", run).groupBy(*of, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), first)
    spans = spans.where(F.col("words") >= min_words)
    return spans.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kept.kept_doc_id", "kept.kept_place"))).alias("gone"))


def deduplicate(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, least: int = LEAST) -> DataFrame:
    """``docs`` with repeated passages taken out of the texts and a column ``removed``: array of (start, end, kept_doc_id, kept_place).

    A row for each row of ``docs``; n_chars, if there, follows the new text. Texts without repeated passages, null and
    empty ones stay as they are with nothing removed; for repeated and null ids see ``repeated_units``. Other columns, of any
    name but ``removed``, stay as they are; whole texts are read, of any length. An empty table gives none.
    """
    spans = cut(passages(repeated_units(docs, unit, least), min_words))
    n_spans = spans.agg(F.sum(F.size("gone") + 1)).head()[0] or 0
    rows = docs.select(packed(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"), "text")
    spans = spans.withColumnsRenamed({"doc_id": "span_id"})
    joined = rows.join(small(spans, n_spans), F.col("id").eqNullSafe(F.col("span_id")) & (F.col("of") == F.col("mark")), "left")
    before = lambda i: F.when(i > 0, F.get("gone", i - 1)["end"]).otherwise(0)
    left = let(chunks(F.col("text")), lambda of: F.concat(F.array_join(F.transform("gone", lambda g, i: between(of, before(i), g["start"])), ""), between(of, F.element_at("gone", -1)["end"], F.length("text"))))
    joined = joined.withColumn("new", F.when(F.col("gone").isNotNull(), left).otherwise(F.col("text")))
    n_chars = F.when(F.col("gone").isNotNull(), F.length("new").cast("long"))
    changed = {"text": F.col("new")} | ({"n_chars": n_chars.otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    none = F.array().cast("array<struct<start:int,end:int,kept_doc_id:bigint,kept_place:int>>")
    return joined.select(*unpacked(docs, **changed), F.coalesce("gone", none).alias("removed"))
