"""Judge scores: validity and normalised total."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scored qualities, their weights, range and divisor.
SCORES = ("neutrality", "meaning_preservation", "fluency", "edit_minimality")
WEIGHTS = (1.0, 1.0, 0.5, 0.5)
LOWEST, HIGHEST = -3, 3
DIVISOR = 9.0

RESULT_TYPE = (
    "neutrality int, meaning_preservation int, fluency int, edit_minimality int, "
    "overall_reasoning string"
)


def judge_valid() -> Column:
    """True when all four scores are present and in range."""
    valid = F.lit(True)
    for score in SCORES:
        valid = valid & F.coalesce(F.col(score).between(LOWEST, HIGHEST), F.lit(False))
    return valid


def judge_total() -> Column:
    """Weighted sum of the four scores, scaled to [-1, 1]."""
    total = F.lit(0.0)
    for score, weight in zip(SCORES, WEIGHTS):
        total = total + F.col(score) * F.lit(weight)
    return total / F.lit(DIVISOR)


def judge_score() -> Column:
    """The total, or 0.0 where the judge gave nothing usable."""
    return F.when(judge_valid(), judge_total()).otherwise(F.lit(0.0))
