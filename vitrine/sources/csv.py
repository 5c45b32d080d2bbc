"""Header CSV sources read with explicit all-text schemas (no inference)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.schema import (APP_GENRES_CSV_SCHEMA, CATALOG_CSV_SCHEMA, EMBEDDING_MAP_CSV_SCHEMA,
                            GENRES_CSV_SCHEMA, REVIEWS_CSV_SCHEMA)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             quoted: bool = True) -> DataFrame:
    """Header CSV, every column text.

    ``quoted=True`` reads quoted fields that hold doubled quotes and line
    breaks (``escape='"'``, ``multiLine``), one task per file;
    :func:`read_quoted` reads such a file with many tasks. ``quoted=False`` is
    the plain line-based reader, which splits large files but breaks rows at
    embedded newlines.
    """
    r = spark.read.option("header", True).option("inferSchema", False)
    if quoted:
        r = r.option("escape", '"').option("multiLine", True)
    if schema is not None:
        r = r.schema(schema).option("enforceSchema", False)
    return r.csv(path)


# --- quoted files read by many tasks ---

WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3  # a record; the end, a part, the begin of one that crosses ranges
PIECES = "file string, start bigint, crlf boolean, seq bigint, kind int, record string"
PIECES_SCHEMA = pa.schema([("file", pa.string()), ("start", pa.int64()), ("crlf", pa.bool_()), ("seq", pa.int64()), ("kind", pa.int32()),
                           ("record", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order, with the state at the start of their range, to records
    and the pieces of records that cross the edges of the range."""
    at, held, inside, crossing, seq = None, [], False, False, 0
    out: list[tuple] = []

    def close() -> None:
        if held:
            out.append((*at, seq, MIDDLE if crossing else TAIL, "\n".join(held)))

    for batch in batches:
        for line, file, start, odd, crlf in zip(
                *(batch.column(c).to_pylist() for c in ("value", "file", "start", "odd", "crlf"))):
            if at is None or (file, start) != at[:2]:
                close()
                if odd is None:
                    raise ValueError(f"{file}: ranges changed while the file was read")
                at, held, inside, crossing, seq = (file, start, crlf), [], odd, odd, 0
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                out.append((*at, seq, HEAD if crossing else WHOLE, "\n".join(held)))
                held, crossing, seq = [], False, seq + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES_SCHEMA)],
                                             schema=PIECES_SCHEMA)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES_SCHEMA)],
                                         schema=PIECES_SCHEMA)


def quoted_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, crlf, seq, record): the records of quoted CSV files as text, read in
    byte ranges by many tasks.

    Spark's line reader splits the files. A first pass counts the quotes of every
    range; the sums before a range tell whether it starts inside quotes (a doubled
    quote counts twice and changes nothing). In a second pass each range cuts its
    records where a line ends outside quotes; the pieces of a record that crosses
    ranges, a few per range, are joined by the range in which it began.

    Quotes must only stand around fields and, doubled, within them (RFC 4180)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ends = F.min_by(F.endswith(F.col("value"), F.lit("\r")), F.col("place"))  # of a range's first line
    ranges = lines.withColumn("place", F.monotonically_increasing_id()).groupBy("file", "start").agg(
        F.sum(quotes).alias("n"), ends.alias("crlf"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # one thin row per range of the files
    state = ranges.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("odd"),
                          F.first("crlf").over(Window.partitionBy("file").orderBy("start")).alias("crlf")).checkpoint()
    pieces = lines.join(F.broadcast(state), ["file", "start"], "left").mapInArrow(_cut, PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "start", "crlf", "seq", "record")
    order = Window.partitionBy("file").orderBy("start", "kind")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn(
        "begun", F.last(F.when(F.col("kind") == TAIL, F.struct("start", "seq")), ignorenulls=True).over(order))
    crossing = parts.groupBy("file", "crlf", "begun").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts")).select(
        "file", "begun.start", "crlf", "begun.seq", F.array_join(F.col("parts.record"), "\n").alias("record"))
    return whole.unionByName(crossing)


def read_quoted(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Header CSV with quoted multi-line fields, every column text: the rows of
    ``read_csv(quoted=True)``, but each file is read by many tasks. Compressed
    files cannot be split; they take one task each here too."""
    if schema is None:
        schema = read_csv(spark, path).schema
    records = quoted_records(spark, path).where(~((F.col("start") == 0) & (F.col("seq") == 0)))
    # a file with CR LF line ends has LF in its fields, as Spark's reader gives them
    text = F.regexp_replace(F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record")),
                            "\r$", "")
    return records.select(text.alias("record")).where(F.col("record") != "").select(
        F.from_csv("record", ", ".join(f"`{f.name}` string" for f in schema.fields),
                   {"escape": '"', "multiLine": "true"}).alias("row")).select("row.*")


# Without a schema, columns are named by the header and every one is text
# (no inference). ``strict=True`` imposes the full positional schema instead
# (no header job, but the file must carry exactly those columns).

def read_catalog_csv(spark, path, quoted: bool = True, strict: bool = False) -> DataFrame:
    return read_csv(spark, path, CATALOG_CSV_SCHEMA if strict else None, quoted)


def read_reviews_csv(spark, path, strict: bool = False, quoted: bool = True) -> DataFrame:
    return read_csv(spark, path, REVIEWS_CSV_SCHEMA if strict else None, quoted)


def convert_reviews(spark, csv_path: str, out: str, quoted: bool = True) -> DataFrame:
    """Reviews as parquet, every column text: quoted files are read once, in
    ranges by many tasks, everything later reads parquet. Returns the written
    table."""
    source = read_quoted(spark, csv_path) if quoted else read_reviews_csv(spark, csv_path, quoted=False)
    source.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def read_app_genres_csv(spark, path, strict: bool = False) -> DataFrame:
    return read_csv(spark, path, APP_GENRES_CSV_SCHEMA if strict else None, True)


def read_genres_csv(spark, path, strict: bool = False) -> DataFrame:
    return read_csv(spark, path, GENRES_CSV_SCHEMA if strict else None, True)


def read_embedding_map(spark, path) -> DataFrame:
    """``appid`` text, ``vector_index`` integer (bad -> null)."""
    m = read_csv(spark, path, EMBEDDING_MAP_CSV_SCHEMA, True)
    return m.select(F.col("appid").cast("string"),
                    F.col("vector_index").try_cast("bigint").alias("vector_index"))
