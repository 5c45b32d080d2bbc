"""Parquet sources and sinks: optional tables, overwrite, resumable append,
table definitions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import checkpoint_path, ensure_checkpoint_dir


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty frame with ``schema`` when the path
    does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite sink. Never point it at a path the same plan reads."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str, schema: T.StructType) -> int:
    """Resumable sink: append only rows whose key is not in the table yet.

    Returns the number of appended rows (one count). Re-running after a
    crash appends nothing twice; it replaces "rewrite everything every n
    rows" with one append of the missing rows.
    """
    existing = read_optional(spark, path, schema)
    new = df.join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    new = new.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    new = new.checkpoint()  # the written rows are exactly the counted rows
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def append_in_chunks(spark: SparkSession, inputs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, key: str,
                     schema: T.StructType, chunk_rows: int) -> int:
    """Resumable sink of slow work (model calls): ``work`` turns the ``inputs`` whose
    key is not in the table yet into rows of ``schema``, chunk by chunk of about
    ``chunk_rows`` inputs, and each chunk is appended on its own.

    The inputs are written once, dealt to chunks by a hash of their key; a chunk reads
    only its folder. The table itself is the log of what is done: a lost driver repeats
    one chunk at most, and the next run takes up the keys that are missing, whatever its
    chunks are. Rows of a chunk that was cut off in its append are found by their keys.
    Returns the number of appended rows."""
    done = read_optional(spark, out, schema).select(F.col(key).alias("__done")).where(F.col("__done").isNotNull())
    pending = inputs.join(done, F.col(key) == F.col("__done"), "left_anti")
    ensure_checkpoint_dir(spark)
    path = checkpoint_path(spark, f"pending-{uuid.uuid4().hex[:12]}")
    pending.write.parquet(path)
    stored = spark.read.schema(pending.schema).parquet(path)
    n = stored.count()
    if not n:
        return 0
    chunks = -(-n // max(chunk_rows, 1))
    if chunks > 1:
        dealt = f"{path}-chunks"
        stored.withColumn("__chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")).hint(
            "rebalance", "__chunk").write.partitionBy("__chunk").parquet(dealt)
        stored = spark.read.schema(T.StructType(pending.schema.fields + [T.StructField("__chunk", T.IntegerType())])).parquet(
            dealt)
    for chunk in range(chunks):
        part = stored if chunks == 1 else stored.where(F.col("__chunk") == chunk).drop("__chunk")
        rows = work(part).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        rows.write.mode("append").parquet(out)
    return n


def create_table_if_absent(spark: SparkSession, name: str, schema: T.StructType, location: str | None = None,
                           partitioned_by: list[str] | None = None) -> None:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet`` from a schema.
    Uniqueness of a primary key is kept by the upsert, not by the table."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    part = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{part}{loc}")
