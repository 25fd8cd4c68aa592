"""Vector functions on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SKETCH = 64


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where one has no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norm)


def distance_to(a: Column, q: list[float]) -> Column:
    """The same to a fixed vector, whose length is worked out once."""
    fixed = F.array(*[F.lit(float(x)) for x in q]).cast("array<double>")
    n = F.least(F.size(a), F.lit(len(q)))
    whole = 0.0
    for x in q:
        whole += float(x) * float(x)
    part = F.slice(fixed, F.lit(1), n)
    norm = F.sqrt(dot(F.slice(a, F.lit(1), n), a)) * F.when(n == len(q), F.lit(math.sqrt(whole))).otherwise(F.sqrt(dot(part, part)))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - dot(a, fixed) / norm)


def sketched(v: list[float], size: int = SKETCH) -> list[float]:
    """sketch() of a fixed vector."""
    bucket, out = max(1, math.ceil(len(v) / size)), []
    for i in range(size):
        s = 0.0
        for x in v[i * bucket : (i + 1) * bucket]:
            s += float(x)
        out.append(s)
    return out


def sketch(v: Column, size: int = SKETCH) -> Column:
    """sums of consecutive buckets."""
    bucket = F.greatest(F.lit(1), F.ceil(F.size(v) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.slice(v, (i * bucket + 1).cast("int"), bucket), F.lit(0.0), lambda s, x: s + x))


def magnitude(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = magnitude(v)
    return F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))
