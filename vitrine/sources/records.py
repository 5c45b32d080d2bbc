"""JSON-safe output records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ieee_divide(a: Column, b: Column) -> Column:
    """Float division with IEEE results for a zero divisor (+-inf, NaN)
    instead of ANSI's error."""
    a, b = a.cast("double"), b.cast("double")
    return (F.when(b != 0, a / F.when(b != 0, b))
            .when(a > 0, F.lit(float("inf")))
            .when(a < 0, F.lit(float("-inf")))
            .when(a == 0, F.lit(float("nan"))))


def json_safe(df: DataFrame, text_defaults: dict[str, str] | None = None) -> DataFrame:
    """NaN and +-inf -> null in every float column; null text of the given
    columns -> default (``short_description`` -> "" by default)."""
    defaults = {"short_description": ""} if text_defaults is None else text_defaults
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)
        elif f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        out.append(c.alias(f.name))
    return df.select(*out)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row (``value`` column), after :func:`json_safe`."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*safe.columns)).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_safe(df).write.mode(mode).json(path)
