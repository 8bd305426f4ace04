"""Number expressions, with the guards that ANSI mode needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null, unlike with greatest() and least()."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def f_half(tp: Column, fp: Column, fn: Column) -> Column:
    """F-score with beta 0.5 from counts; 1 where there is nothing to find and nothing was found."""
    bottom = F.lit(1.25) * tp + F.lit(0.25) * fn + fp
    return F.when(bottom > 0, F.lit(1.25) * tp / bottom).otherwise(F.lit(1.0))


def smoothed_log_odds(n: Column, positive: Column, prior: Column, strength: float = 30.0) -> Column:
    """Log-odds of a rate drawn to the prior by `strength` observations, between 1e-4 and 1 - 1e-4."""
    q = clip((positive + F.lit(strength) * prior) / (n + F.lit(strength)), 1e-4, 1 - 1e-4)
    return F.log(q) - F.log(1 - q)


def l2_normalized(c: Column) -> Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def bucket(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n))
