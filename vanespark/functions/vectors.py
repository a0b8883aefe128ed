"""Vector arithmetic as column expressions: the readable form, for projections and small query tables."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(str, Enum):
    """Similarity in which higher is better: negated squared distance, or cosine."""

    L2 = "l2"
    COSINE = "cosine"

    @classmethod
    def parse(cls, name: str) -> Metric:
        """Case-insensitive; unknown names raise."""
        try:
            return cls(name.strip().lower())
        except ValueError:
            raise ValueError(f"unknown metric {name!r}: use l2 or cosine") from None

    @property
    def is_cosine(self) -> bool:
        return self is Metric.COSINE


def _col(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it: inside a lambda nothing else is shared."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def l2_squared(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x * x)))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where either side has no length."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def normalized(a: str | Column) -> Column:
    """Length one; a zero vector stays zero."""
    return let(_col(a), lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def subtract(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def sub_vector(a: str | Column, j: int, width: int) -> Column:
    return F.slice(_col(a), j * width + 1, width)


def score(metric: Metric, a: str | Column, b: str | Column) -> Column:
    return cosine(a, b) if metric.is_cosine else -l2_squared(a, b)


def decayed(score: str | Column, ts: str | Column, now: int, rate: float) -> Column:
    """Score weakened with age: positive ones times exp(-rate * age), others divided by it; no decay for rate <= 0.

    Age is never negative, and the factor never under 1e-9.
    """
    s = F.col(score) if isinstance(score, str) else score
    if rate <= 0:
        return s
    t = F.col(ts) if isinstance(ts, str) else ts
    f = F.greatest(F.exp(-F.lit(float(rate)) * F.greatest(F.lit(now) - t, F.lit(0))), F.lit(1e-9))
    return F.when(s > 0, s * f).otherwise(s / f)


def tags_match(tags: str | Column, mask: int, mode: str = "all") -> Column:
    """Rows whose tag bits hold all (or any) of mask's; null tags match nothing."""
    if mode not in ("all", "any"):
        raise ValueError("mode is all or any")
    hit = (F.col(tags) if isinstance(tags, str) else tags).bitwiseAND(F.lit(mask))
    return F.coalesce(hit == mask if mode == "all" else hit != 0, F.lit(False))
