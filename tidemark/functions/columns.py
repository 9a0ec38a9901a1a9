"""Small scalar functions as Column algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def neglog10_naive(p: Column, floor: float = 323.0) -> Column:
    """-log10 of a p that nothing else tells more about: ``floor`` where it is 0 or below, null where it isn't finite."""
    number = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return F.when(number & (p > 0), -F.log10(p)).when(number, F.lit(floor))


def logit(p: Column, edge: float = 1e-12) -> Column:
    """Log odds of p held within [edge, 1 - edge]; null where p is."""
    held = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.when(p.isNotNull(), F.log(held / (1 - held)))


def numbers(spec: Column) -> Column:
    """The whole numbers of a list such as "1-5,9", in its order; empty parts count for nothing."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.transform(parts, lambda x: F.transform(F.split(x, "-"), lambda y: F.trim(y).cast("int")))
    return F.flatten(F.transform(ends, lambda x: F.when(F.element_at(x, -1) >= x[0], F.sequence(x[0], F.element_at(x, -1))).otherwise(F.array().cast("array<int>"))))
