"""Vector column functions over ``array<float|double>`` columns.

Spark has no vector type for SQL columns, so dot products are expressed with
the higher-order functions ``zip_with`` and ``aggregate`` (JVM-side, no
Python). Elements are accumulated in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Unit-length vector as array<double>; a zero vector stays zero (no /0).

    The sum of squares is accumulated once per row and handed to the
    ``aggregate`` finish step, which scales the elements. (A norm written
    inside the element lambda is re-evaluated for every element: quadratic
    in the dimension.)
    """
    c = _c(v)
    return F.aggregate(
        c, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda ss: F.transform(c, lambda x: F.when(ss > 0, x.cast("double") / F.sqrt(ss))
                               .otherwise(F.lit(0.0))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
