"""Class probabilities of an ordered model, as expressions over one row.

``q`` is the list of conditional probabilities P(class > k | class >= k), one
per class but the last. ``prob`` is the array of class probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F


def chain(q: Sequence[Column]) -> list[Column]:
    """P(k) = (1 - q_k) * q_0 * ... * q_{k-1}; the last class takes the rest."""
    out = []
    reached: Column | None = None
    for qk in q:
        stop = F.lit(1.0) - qk
        out.append(stop if reached is None else reached * stop)
        reached = qk if reached is None else reached * qk
    return out + [reached]


def chain_array(q: Sequence[Column]) -> Column:
    return F.array(*chain(q))


def cumulative(prob: Column, n: int) -> list[Column]:
    """Running sums along the class axis."""
    return [reduce(add, [prob[i] for i in range(k + 1)]) for k in range(n)]


def median_code(prob: Column, n: int) -> Column:
    """First class whose cumulative probability reaches one half, else class 0."""
    sums = cumulative(prob, n)
    pick = F.when(sums[0] >= 0.5, 0)
    for k in range(1, n):
        pick = pick.when(sums[k] >= 0.5, k)
    return pick.otherwise(0)


def modal_code(prob: Column) -> Column:
    """Most probable class; the lowest one on a tie."""
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def expected_code(prob: Column, n: int) -> Column:
    """Expected class, sum of k * P(k)."""
    return reduce(add, [prob[k] * F.lit(float(k)) for k in range(n)])


def percent(p: Column) -> Column:
    """Whole percent, halves to the even neighbour."""
    return F.bround(p * 100).cast("int")


def log_loss_term(prob: Column, code: Column, floor: float = 1e-15) -> Column:
    """-log of the probability given to the true class."""
    return -F.log(F.greatest(F.element_at(prob, code + 1), F.lit(floor)))


def product(factors: Sequence[Column]) -> Column:
    return reduce(mul, factors)
