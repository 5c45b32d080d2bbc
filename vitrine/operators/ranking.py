"""Ordering helpers: top-k per group, first row per key, rank numbers.

The global top-k is an ordered limit (each task keeps ``k`` rows, then the
merge), numbered afterwards. The top-k per group is taken twice: within salted
parts of each group, then over what is left of the group. So a hot group is
never ordered in one task, whatever ``k`` is; up to ``k`` of 1000 Spark also
limits the rows of each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK_COL = "rank"


SALTS = 64


def _row_hash(df: DataFrame) -> Column | None:
    """A hash of the whole row (maps have none)."""
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*hashable) if hashable else None


def best_per_group(df: DataFrame, group_cols: Sequence[str | Column], order: Sequence[Column], k: int,
                   rank_col: str = RANK_COL) -> DataFrame:
    """As :func:`top_k_per_group` for groups of bounded size: one shuffle."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def top_k_per_group(df: DataFrame, group_cols: Sequence[str | Column], order: Sequence[Column],
                    k: int, rank_col: str = RANK_COL) -> DataFrame:
    """Keep the first ``k`` rows per group under ``order``; adds ``rank`` 1..k.

    ``order`` must end with a unique key so ties are deterministic.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    salt = _row_hash(df)
    if salt is not None:
        salted = df.withColumn("__salt", F.pmod(salt, F.lit(SALTS)))
        df = best_per_group(salted, [*group_cols, "__salt"], order, k, rank_col).drop("__salt", rank_col)
    return best_per_group(df, group_cols, order, k, rank_col)


def top_k(df: DataFrame, order: Sequence[Column], k: int, rank_col: str = RANK_COL) -> DataFrame:
    """Global top-k with a rank column: at most ``k`` rows per task and in the
    one partition that numbers them."""
    if k <= 0:
        raise ValueError("k must be positive")
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order`` (dedup with an explicit order,
    unlike ``dropDuplicates`` which keeps an arbitrary row).

    Rows tied under ``order`` are ordered by a hash of the whole row, so the
    choice is the same in every run and every task retry (rows equal in all
    columns are interchangeable)."""
    tie = _row_hash(df)
    order = [*order] if tie is None else [*order, tie.asc()]
    return best_per_group(df, keys, order, 1, "__rn").drop("__rn")
