"""Quality filtering by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Every rule reads the statistics of a whole text and votes +1 (prose), -1 (junk) or 0. Junk comes in kinds, and one rule
sees one kind, so asking for all rules to pass, or for a majority, is wrong either way; EM estimates for each rule how
often it votes +1 on either class and the posterior quality probability replaces all-must-pass filtering.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, packed, stored, unpacked
from .vote_model import VoteModel, fit, patterns

WINDOW = 8
KEEP_AT = 0.5
#: A rule that votes on prose is right 995 times in 1000 at least; rarer alarms than that mean junk of one kind.
LEAST_RIGHT = 0.995
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_stops", "n_bars")
BASE = STATS[:5]
_BLANK, _SYMBOLS, _UPPER = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, its first place included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    _, which, times = np.unique(mixed, return_inverse=True, return_counts=True)
    hits = np.flatnonzero(times[which] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = text.translate(None, _BLANK)
    return (
        len(words),
        len(bare.translate(None, _CONTINUATION)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(set(words)),
        len(text) - len(text.translate(None, _UPPER)),
        len(text) - len(text.translate(None, _LETTERS)),
        text.count(b". ") + text.count(b".\n") + text.endswith(b"."),
        words.count(b"|"),
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in STATS]))
def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS...) of whole texts; a null text has none of anything."""
    return docs.select("doc_id", _stats(F.col("text").cast("binary")).alias("s")).select("doc_id", "s.*")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes. Division is by counts that the first condition of ``sized`` keeps above zero."""
    n, long_enough = F.col("n_words"), F.col("n_words") >= 20
    sized = lambda x: F.when(long_enough, x).otherwise(F.lit(0))
    mean, letters = F.col("word_chars") / F.greatest(n, F.lit(1)), F.greatest(F.col("n_letters"), F.lit(1))
    return {
        "v_symbols": sized(_vote(F.col("n_symbols") > 0.3 * n, F.col("n_symbols") <= 0.1 * n)),
        "v_repeats": sized(_vote(F.col("n_repeat_words") > 0.25 * n, F.col("n_repeat_words") <= 0.15 * n)),
        "v_lines": sized(F.when(F.col("n_lines") >= 5, _vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.col("n_dup_lines") <= 0.1 * F.col("n_lines"))).otherwise(0)),
        "v_length": sized(_vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 10))),
        "v_capitals": sized(_vote(F.col("n_upper") > 0.4 * letters, F.col("n_upper") <= 0.15 * letters)),
        "v_variety": F.when(n >= 50, _vote(F.col("n_distinct") < 0.15 * F.sqrt(n) + 0.02 * n, F.col("n_distinct") >= 2 * F.sqrt(n))).otherwise(0),
        "v_sentences": F.when(n >= 60, _vote(F.col("n_stops") * 150 < n, F.col("n_stops") * 60 >= n)).otherwise(0),
        "v_tables": sized(_vote(F.col("n_bars") > 0.2 * n, F.col("n_bars") <= 0.02 * n)),
    }


def learn(votes: DataFrame) -> VoteModel:
    names = list(rules())
    return fit(patterns(votes, names), names, one_against=0.35, least_right=LEAST_RIGHT)


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def score_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS..., votes, base_failed, p_quality, kept), a row for each row of ``docs``.

    base_failed: under 20 words, or over 30 % of the words repeat in 8-word windows. kept is false where base_failed, else
    p_quality >= ``KEEP_AT``. Null and empty texts have 0 words and fail. Equal texts get equal verdicts, repeated rows and
    null ids stay as rows; an empty table gives none. Only doc_id and text are read, and no text is shortened.
    """
    scored = cut(statistics(docs).withColumns(rules()))
    model = learn(scored)
    out = scored.withColumn("base_failed", _base_failed()).withColumn("p_quality", model.column())
    return out.withColumn("kept", _passes(model))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns, whatever their names.

    Rows are written once with their statistics, so texts are read once and nothing is joined. Null and empty texts go;
    null ids, ties and repeated rows are judged by their own texts, which may be of any length; an empty table gives none.
    """
    rows = docs.select(packed(docs), _stats(F.col("text").cast("binary")).alias("s")).select("row", "s.*")
    rows = stored(rows).withColumns(rules())
    return rows.where(_passes(learn(rows))).select(*unpacked(docs))


def _passes(model: VoteModel) -> Column:
    return ~_base_failed() & (model.column() >= KEEP_AT)
