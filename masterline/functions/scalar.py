"""Scalar maths and coding rules used across the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-6


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def inv_logit(x: Column) -> Column:
    """Logistic in the form that does not overflow for large positive x."""
    return 1.0 / (1.0 + F.exp(-x))


def clip_prob(p: Column, eps: float = CLIP) -> Column:
    """Keep a probability off 0 and 1: ln(0) is NULL in Spark, not -Inf."""
    return F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))


def normal_density(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2.0 * math.pi))


def square(x: Column) -> Column:
    return x * x


def pairwise_max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def bit(mask: Column, position) -> Column:
    """The 0/1 value of one bit of an integer mask."""
    return F.shiftright(mask, position).bitwiseAND(1).cast("int")


def held_all(mask: Column, needed: Column) -> Column:
    return mask.bitwiseAND(needed) == needed


def mastered(p: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """1/0 by threshold.  ``inclusive`` leaves NULL as NULL; the strict rule
    has a default branch, so there NULL becomes 0."""
    if inclusive:
        return F.when(p >= threshold, 1).when(p < threshold, 0)
    return F.when(p > threshold, 1).otherwise(0)


def row_sum(cols: list[str | Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) if isinstance(c, str) else c for c in cols])


def ifelse(test: Column, yes, no) -> Column:
    """Two-way choice; a NULL test gives NULL, as in the vectorised original."""
    return F.when(test, yes).when(~test, no)


def case_when(*branches: tuple[Column, object], default=None) -> Column:
    """First matching branch; NULL when nothing matches and no default."""
    out = F
    for test, value in branches:
        out = out.when(test, value)
    return out if default is None else out.otherwise(default)


# The two marks and the three status colours of the result tables.
CHECK, CROSS = "check", "xmark"
MASTER_COLOUR, NONMASTER_COLOUR = "#487398", "#A91E47"


def to_mark(x: Column) -> Column:
    return F.when(x == 1, CHECK).when(x == 0, CROSS)


def from_mark(x: Column) -> Column:
    return F.when(x == CROSS, 0).when(x == CHECK, 1)


def mark_colour(mark: Column) -> Column:
    return F.when(mark == CROSS, NONMASTER_COLOUR).when(mark == CHECK, MASTER_COLOUR)


def threshold_band(x: Column, cut: float, below: str, above: str) -> Column:
    return F.when(x <= cut, below).when(x > cut, above)
