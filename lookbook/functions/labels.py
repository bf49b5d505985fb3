"""Class predictions: softmax, top-k lists, wide and long forms, keyword filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("sunglass", "sunglasses", "shades")
MIN_PROB = 0.05


def softmax(logits: Column) -> Column:
    raised = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def top_k(probs: Column, names: Column, k: int) -> Column:
    """array<struct<label, prob>> of the k largest, the earlier class first among equals."""
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("order"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(F.get(names, r["i"]).alias("label"), (-r["order"]).alias("prob")))


def mentions(top: Column, keywords: tuple[str, ...] = KEYWORDS, min_prob: float = MIN_PROB) -> Column:
    """Whether any label holds a keyword at ``min_prob`` or more."""

    def hit(t: Column) -> Column:
        found = F.lit(False)
        for word in keywords:
            found = found | F.contains(F.lower(t["label"]), F.lit(word))
        return found & (t["prob"] >= min_prob)

    return F.coalesce(F.exists(top, hit), F.lit(False))


def widen(df: DataFrame, top: str, k: int) -> DataFrame:
    out = df
    for i in range(k):
        out = out.withColumn(f"top{i + 1}_label", F.get(F.col(top), i)["label"]).withColumn(f"top{i + 1}_prob", F.get(F.col(top), i)["prob"])
    return out.drop(top)


def narrow(df: DataFrame, top: str, k: int) -> DataFrame:
    """Back from the wide form; places without label are dropped."""
    items = F.array(*(F.struct(F.col(f"top{i + 1}_label").alias("label"), F.col(f"top{i + 1}_prob").alias("prob")) for i in range(k)))
    wide = [f"top{i + 1}_{x}" for i in range(k) for x in ("label", "prob")]
    return df.withColumn(top, F.filter(items, lambda t: t["label"].isNotNull())).drop(*wide)
