"""Expectation-maximisation over the votes of imperfect labelers.

Votes are +1, -1 or 0 (abstains). Given the hidden class, a labeler that votes is right with a probability of its own for
each class; labelers are independent. Fitting reads counts of distinct vote patterns: at most 3 ** labelers rows, whatever
the size of the corpus, so the patterns are aggregated on Spark and only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patterns(votes: DataFrame, labelers: list[str]) -> list[tuple[tuple[int, ...], float]]:
    """Counts of vote patterns over all rows, combined before the shuffle; bounded by 3 ** len(labelers)."""
    return sorted((tuple(int(r[c]) for c in labelers), float(r["n"])) for r in votes.groupBy(*labelers).agg(F.count("*").alias("n")).collect())


class VoteModel:
    """Prior and, for each labeler, the log-odds that its +1 or -1 adds to those of the positive class."""

    def __init__(self, labelers: list[str], prior: float, given_pos: list[float], given_neg: list[float]):
        self.labelers, self.prior, self.given_pos, self.given_neg = labelers, prior, given_pos, given_neg
        self.bias = log(prior / (1 - prior))
        self.plus = [log(p / q) for p, q in zip(given_pos, given_neg, strict=True)]
        self.minus = [log((1 - p) / (1 - q)) for p, q in zip(given_pos, given_neg, strict=True)]

    def posterior(self, votes: tuple[int, ...]) -> float:
        z = self.bias + sum(self.plus[j] if v > 0 else self.minus[j] for j, v in enumerate(votes) if v)
        return 1 / (1 + exp(-max(-500.0, min(500.0, z))))

    def column(self) -> Column:
        """The posterior as a Spark expression over the vote columns."""
        z = F.lit(self.bias)
        for name, plus, minus in zip(self.labelers, self.plus, self.minus, strict=True):
            z = z + F.when(F.col(name) > 0, F.lit(plus)).when(F.col(name) < 0, F.lit(minus)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit(counts: list[tuple[tuple[int, ...], float]], labelers: list[str], one_against: float = 0.5, least_right: float = 0.5, rounds: int = 60, smooth: float = 2.0, start: Callable[[tuple[int, ...]], float] | None = None) -> VoteModel:
    """``start``: the belief in the positive class that a vote pattern is first given; without it, where one labeler votes -1 that
    belief is ``one_against``, and falls by as much with each more.

    ``least_right``: how often a labeler votes +1 on the positive class, at least. Kinds of negatives that each trip one
    labeler only would otherwise pass as positives on which that labeler errs.
    A labeler keeps the meaning of its votes: +1 is never made likelier by the negative class. No rows give the start.
    """
    m = len(labelers)
    model = VoteModel(labelers, 0.9, [0.98] * m, [0.98 - 0.5 * (1 - one_against)] * m)
    first = {p: start(p) if start else one_against ** sum(v < 0 for v in p) * 0.98 for p, _ in counts}
    for step in range(rounds if counts else 0):
        pos = first if step == 0 else {p: model.posterior(p) for p, _ in counts}
        total, whole = sum(n for _, n in counts), sum(n * pos[p] for p, n in counts)
        given_pos, given_neg = [], []
        for j in range(m):
            up = sum(n * pos[p] for p, n in counts if p[j] > 0)
            voted = sum(n * pos[p] for p, n in counts if p[j])
            up_neg = sum(n * (1 - pos[p]) for p, n in counts if p[j] > 0)
            voted_neg = sum(n * (1 - pos[p]) for p, n in counts if p[j])
            a = (up + smooth * 0.98) / (voted + smooth)
            b = (up_neg + smooth * 0.5) / (voted_neg + smooth)
            a = min(max(a, least_right), 0.9995)
            given_pos.append(a)
            given_neg.append(min(max(b, 0.0005), a - 0.0002))
        model = VoteModel(labelers, min(max((whole + 1) / (total + 2), 0.02), 0.98), given_pos, given_neg)
    return model
