"""Language of whole texts by language-bitmask n-gram filters.

Training counts the character n-grams of every labelled text, combined in the tasks before the shuffle. A language contains a
gram if the gram makes up ``LEAST_RATE`` of the language's grams or more, and no less than ``LEAST_SHARE`` of the rate that
it has in the language where it is most frequent. All languages share one bit-sliced Bloom filter: a position holds a mask with a bit
a language, so the masks at a gram's positions, and-ed, name all languages that contain it. A text's popcounts by
language, corrected for the false positives that the filter's fill predicts, decide.

Size of what is sent to tasks: rates of a language add up to 1, so it contains 1 / ``LEAST_RATE`` grams at most, the filter
has 2^20 positions at most, and with ``MOST_LANGUAGES`` languages 64 MB at most; a table with more languages is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

N = 4
LEAST_RATE = 1e-5
LEAST_SHARE = 0.1
MOST_LANGUAGES = 512
PROBES = 4
#: Characters that are hashed at once, and grams that a training task holds before it lets their counts go.
CHUNK, HELD = 1 << 20, 1 << 21
UNKNOWN = "und"
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def gram_hashes(text: str, n: int = N) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of the lower-cased words of ``text``, blanks between and around them, a chunk at a time."""
    words = _OTHER.sub(" ", text.lower()).strip(" ")
    if not words:
        return
    padded = " " * (n // 2) + words + " " * (n // 2)
    for at in range(0, max(1, len(padded) - n + 1), CHUNK):
        points = np.frombuffer(padded[at : at + CHUNK + n - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = len(points) - n + 1
        if size > 0:
            h = np.full(size, n, np.uint64)
            for i in range(n):
                h = (h ^ points[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield h


def gram_counts(docs: DataFrame, n: int = N) -> DataFrame:
    """(lang, gram, n) over all texts that have a language; a task lets go of combined counts, so a hot language is no hot task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                gram, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": count.astype(np.int64)})
            held.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                for h in gram_hashes(text, n):
                    held.setdefault(lang, []).append(h)
                    size += len(h)
                    if size >= HELD:
                        yield from out()
                        size = 0
        yield from out()

    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    return labelled.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilter:
    """``bits``: (positions, words) masks of 64 languages a word; ``wrong``: false positives of a gram, by language."""

    languages: list[str]
    bits: np.ndarray
    wrong: np.ndarray
    usual: int
    n: int

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """(grams, words): the languages that contain each gram."""
        last = np.uint64(len(self.bits) - 1)
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        out = self.bits[(hashes & last).astype(np.intp)]
        for i in range(1, PROBES):
            out = out & self.bits[((hashes + np.uint64(i) * step) & last).astype(np.intp)]
        return out

    def popcounts(self, text: str) -> tuple[np.ndarray, int]:
        """How many of the text's grams each language contains, and the number of grams."""
        seen, total = np.zeros(len(self.languages), np.int64), 0
        for h in gram_hashes(text, self.n):
            found = self.masks(h)
            total += len(h)
            for j in range(len(seen)):
                seen[j] += int(((found[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).sum())
        return seen, total

    def decide(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        seen, total = self.popcounts(text)
        true = np.maximum((seen - self.wrong * total) / (1 - self.wrong), 0)
        if not true.any():
            return self.languages[self.usual], 0.0
        best = int(true.argmax()) if true[self.usual] < true.max() else self.usual
        return self.languages[best], float(true[best] / true.sum())


def learn(docs: DataFrame, n: int = N, least_rate: float = LEAST_RATE, least_share: float = LEAST_SHARE) -> LanguageFilter:
    """The filter of all labelled texts of ``docs`` (text, lang). Rows without either, and texts without letters, teach nothing."""
    counts = cut(gram_counts(docs, n))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = [r["lang"] for r in totals]
    words = max(1, -(-len(names) // 64))
    if not names:
        return LanguageFilter([], np.zeros((1, words), np.uint64), np.zeros(0), 0, n)
    known = docs.sparkSession.createDataFrame([(r["lang"], r["total"], j) for j, r in enumerate(totals)], "lang string, total long, bit int")
    rates = counts.join(F.broadcast(known), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= least_rate)
    tops = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("in"))  # a language once
    contained = cut(tops.select("gram", F.explode("in").alias("x"), "top").where(F.col("x.rate") >= least_share * F.col("top")).select("gram", F.col("x.bit").alias("bit")))
    most = contained.groupBy("bit").count().agg(F.max("count")).head()[0] or 1
    size = 1 << max(6, int(np.ceil(np.log2(most * PROBES / np.log(2)))))
    low = lambda c: c.bitwiseAND(F.lit(size - 1))  # noqa: E731  (so that sums don't overflow)
    step = low(F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1)))
    places = F.array(*(low(low(F.col("gram")) + F.lit(i) * step).cast("int") for i in range(PROBES)))
    each = contained.select(F.explode(places).alias("place"), F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("mask"))
    filled = each.groupBy("place", "word").agg(F.bit_or("mask").alias("mask")).toPandas()  # positions of the filter, whatever the corpus
    bits = np.zeros((size, words), np.uint64)
    bits[filled["place"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([((bits[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(names))])
    return LanguageFilter(names, bits, fill**PROBES, int(np.argmax([r["total"] for r in totals])), n)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``docs`` with lang_pred and score (the language's share of all corrected popcounts, 0 to 1); columns of these names are replaced.

    Only the text decides. A null text or one without letters is ``und`` with score 0, as is every text where nothing was learned;
    a text of unknown grams gets the language of most training grams with score 0, which also wins ties. Texts
    may be of any length, rows may repeat, other columns stay as they are; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.decide(t) for t in texts], columns=["lang_pred", "score"])

    found = F.pandas_udf(run, "lang_pred string, score double")(F.col("text"))
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), found.alias("found"))
    return rows.select(*(F.col("row")[c].alias(c) for c in others), "found.lang_pred", "found.score")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the decimal id has remainder 1 by 3; null ids have no remainder."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def predict_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from documents that aren't held out, predicted for all.

    Rows with a null doc_id belong to neither part: nothing is learned from them and held_out is false. See ``identify`` for
    null, empty and very long texts. Repeated rows count as often as they stand.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    model = learn(rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
