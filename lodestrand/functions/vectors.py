"""Column expressions over array<double>: distances, divergences, means. They stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(ZERO), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 where a norm vanishes; the similarity is clipped to [-1, 1]."""
    n = norm(a) * norm(b)
    return F.when(n <= 1e-12, 0.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def js_divergence(a: Column, b: Column) -> Column:
    """Base 2, in [0, 1]; both empty 0, one empty 1."""
    sa, sb = total(a), total(b)

    def kl(source: Column, other: Column, ns: Column, no: Column) -> Column:
        return total(F.zip_with(source, other, lambda x, y: F.when(x > 0, x / ns * F.log2(x / ns / F.greatest((x / ns + y / no) / 2, F.lit(1e-18)))).otherwise(0.0)))

    value = (kl(a, b, sa, sb) + kl(b, a, sb, sa)) / 2
    return F.when((sa <= 1e-18) & (sb <= 1e-18), 0.0).when((sa <= 1e-18) | (sb <= 1e-18), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def profile_distance(a: Column, b: Column) -> Column:
    """Square root of the sum of squared relative changes."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y) / F.greatest(F.abs(x) + F.abs(y), F.lit(1e-12)), 2))))


def rms_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a))


def geomean(v: Column) -> Column:
    return F.exp(total(F.transform(v, lambda x: F.log(F.greatest(x, F.lit(1e-12))))) / F.size(v))
