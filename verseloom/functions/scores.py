"""Arithmetic of ratios, penalties and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    """0/0 is 0, x/0 infinite."""
    return F.when(d == 0, F.when(n == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def coverage_penalty(ratio: Column) -> Column:
    return F.when(ratio.between(0.75, 1.35), F.abs(ratio - 1) * 6).otherwise(18 + 10 * F.least(F.abs(F.ln(F.greatest(ratio, F.lit(0.01)))), F.lit(2.5)))


def least_candidate_words(median: Column) -> Column:
    return F.when(median < 8, F.greatest(F.lit(2), F.ceil(median * 0.45))).otherwise(F.greatest(F.lit(4), F.least(F.lit(30), F.floor(median * 0.45)))).cast("long")


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two intervals over the shorter, 0 to 1."""
    shorter = F.greatest(F.least(e1 - s1, e2 - s2), F.lit(0.001))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.least(e1, e2) - F.greatest(s1, s2)) / shorter))


def line_score(chars: Column) -> Column:
    return F.greatest(chars - 28, F.lit(0)) * 2.0 - F.when(chars <= 28, 12.0).otherwise(0.0)


def candidate_score(consensus: Column, caption: Column, hard: Column, aux: Column, fast: Column, over_target: Column, ratio: Column) -> Column:
    """Score of a strategy's result; a caption, where there is one, outweighs agreement. 0.8 is taken exactly, as the SQL's decimals are: equal scores stay equal."""
    base = F.when(caption.isNull(), consensus * 100.0).otherwise(consensus * 45.0 + caption * 55.0)
    return base - hard * 10.0 - aux * 8 / 10.0 - fast * 4.0 - F.greatest(F.lit(0.0), over_target - 0.30) * 40.0 - F.when(ratio.isNotNull() & ~ratio.between(0.65, 1.45), 15.0).otherwise(0.0)
