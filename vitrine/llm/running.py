"""Running totals along a key, for keys of any size.

Rows are range-partitioned and sorted by (key, order), so a key with a third of
all rows is spread over many tasks; each task numbers and sums its own part, and
what the earlier parts of a key hold is carried over by a window on one or two
marked rows a task. The sorted rows are written once in the shared folder, so
the parts that the carry refers to are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm import common as C

CODE_BITS = 60
MASK = (1 << CODE_BITS) - 1
FIRST, LAST = 1, 2


def _scan(key: str, values: list[str], codes: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key, before, carry = None, 0, dict.fromkeys(values, np.uint64(0))
        held: tuple[pa.RecordBatch, np.ndarray] | None = None

        def marked(batch: pa.RecordBatch, edge: np.ndarray) -> pa.RecordBatch:
            return batch.append_column("edge__", pa.array(edge))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            fresh = np.empty(n, bool)
            fresh[0] = held is None or keys[0] != last_key
            fresh[1:] = keys[1:] != keys[:-1]
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(fresh, at, -1))
            old = start < 0
            pos = at + 1 + np.where(old, before, -start)
            out = batch.append_column("pos__", pa.array(pos))
            for name in values:
                v = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                total = np.cumsum(v, dtype=np.uint64)
                base = np.where(old, np.uint64(0) - carry[name], total[start] - v[start])
                total = total - base
                carry[name] = total[-1]
                if name in codes:
                    total = total & np.uint64(MASK)
                out = out.append_column(f"{name}__", pa.array(total.view(np.int64)))
            out = out.append_column("part__", pa.array(np.full(n, part, np.int64)))
            edge = np.zeros(n, np.int32)
            if held is not None:
                yield marked(*held)
            else:
                edge[0] = FIRST
            held = out, edge
            last_key, before = keys[-1], int(pos[-1])
        if held is not None:
            held[1][-1] |= LAST
            yield marked(*held)
    return run


def running(df: DataFrame, key: str, order: list[str], sums: tuple[str, ...] = (), codes: tuple[str, ...] = (),
            name: str = "running") -> DataFrame:
    """``df`` (key without nulls) with ``pos``, a row's place (from 1) among the
    rows of its key in ``order``, and for each column of ``sums`` and ``codes``
    the total up to and including the row, in its place; totals of ``codes`` are
    taken modulo 2^60. Rows that are equal in key and order come in any order."""
    spark, values = df.sparkSession, [*sums, *codes]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["pos__ bigint"]
                       + [f"`{v}__` bigint" for v in values] + ["part__ bigint", "edge__ int"])
    path = C.work_dir(spark, name)
    df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(
        _scan(key, values, set(codes)), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    last = F.col("edge__").bitwiseAND(LAST) > 0
    earlier = Window.partitionBy(key).orderBy("part__", "pos__").rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str, code: bool):
        kept = F.when(last, F.col(column))
        if not code:
            return F.sum(kept).over(earlier)
        return (F.sum(kept.cast("decimal(38,0)")).over(earlier) % F.lit(1 << CODE_BITS).cast("decimal(38,0)")).cast("bigint")
    marks = rows.where("edge__ > 0").select(
        key, "part__", "edge__", before("pos__", False).alias("pos_c"),
        *[before(f"{v}__", v in codes).alias(f"{v}_c") for v in values])
    carried = marks.where((F.col("edge__").bitwiseAND(FIRST) > 0) & F.col("pos_c").isNotNull()).drop("edge__")
    rows = rows.join(carried, [key, "part__"], "left")

    def total(column: str):
        return F.col(f"{column}__") + F.coalesce(F.col(f"{column}_c"), F.lit(0).cast("bigint"))
    plain = [F.col(c) for c in df.columns if c not in values]
    return rows.select(*plain, total("pos").alias("pos"), *[total(v).alias(v) for v in sums],
                       *[total(v).bitwiseAND(F.lit(MASK)).alias(v) for v in codes])
