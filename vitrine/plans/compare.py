"""Output shaping for the oracle comparison: arrays to text, doubles rounded
to 6 places, integers widened to BIGINT. Applied only at the registry edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE_PLACES = 6


def comparable(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, T.ArrayType):
            c = F.array_join(c.cast(T.ArrayType(T.StringType())), "|")
        elif isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DOUBLE_PLACES)
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
