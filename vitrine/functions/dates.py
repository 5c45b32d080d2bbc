"""Date functions: a permissive release-year parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats of release dates, each with the shape of the texts that it can read. A
# text is parsed once, by the format of its shape; a text of no shape ("Q4 2025",
# "coming soon", "") is null without a parse that fails.
RELEASE_DATE_SHAPES = [
    ("yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"),
    ("yyyy/MM/dd", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$"),
    ("d MMM, yyyy", r"^[0-9]{1,2} [A-Za-z]{3}, [0-9]{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{4,} [0-9]{1,2}, [0-9]{4}$"),
    ("d MMMM, yyyy", r"^[0-9]{1,2} [A-Za-z]{4,}, [0-9]{4}$"),
    ("MMM yyyy", r"^[A-Za-z]{3} [0-9]{4}$"),
    ("yyyy-MM", r"^[0-9]{4}-[0-9]{2}$"),
    ("yyyy", r"^[0-9]{4}$"),
]


def release_year(c: Column | str, data_type: T.DataType | None = None) -> Column:
    """Year of a release date given as date, timestamp or free text.

    Pass ``data_type`` (from ``df.schema``) so the branch is chosen at plan
    time: date/timestamp columns need no parsing.
    """
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(col)
    text = F.trim(col.cast("string"))
    parsed = F.lit(None).cast("timestamp")
    for fmt, shape in reversed(RELEASE_DATE_SHAPES):
        parsed = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt))).otherwise(parsed)
    return F.year(parsed)


def year_in_text(c: Column | str) -> Column:
    """The first free-standing year (19.. or 20..) in a text, e.g. 2025 of
    "Q4 2025"; null without one."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.nullif(F.regexp_extract(text, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1), F.lit("")).cast("int")


def release_year_of(df: DataFrame, column: str = "release_date") -> Column:
    return release_year(column, df.schema[column].dataType)
