"""Vector and score functions as column expressions; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findling.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """a at length one; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return let(norm(a) * norm(b), lambda both: F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), both)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def rank_discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def stable_vector(key: Column, size: int) -> Column:
    """A unit vector that depends on the key alone; stands for an encoder where there is none."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: (F.pmod(F.xxhash64(key, k), F.lit(2_000_003)) - 1_000_001) / F.lit(1_000_001.0))
    return let(raw, lambda r: F.transform(unit(r), lambda x: x.cast("float")))
