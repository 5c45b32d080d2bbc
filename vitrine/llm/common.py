"""Helpers shared by the operators: shared folders, Arrow batches, byte hashing."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import checkpoint_path, ensure_checkpoint_dir

HELD_OUT_FOLD = 1
FOLDS = 3


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def few_files(df: DataFrame) -> DataFrame:
    """For thin results of many tasks: rows dealt anew by size, so that a write
    makes files of a good size instead of one small file per task."""
    return df.hint("rebalance")


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a thin ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    few_files(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def held_out():
    """True for the rows labels may never be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def row_key(df: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``df`` with a 128-bit key of each row's content (all columns, nulls told
    apart) in two bigint columns ``names``: the same for equal rows only."""
    columns = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()
               else F.col(f"`{f.name}`") for f in df.schema]
    nulls = F.concat(F.lit(""), *[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    return df.withColumns({n: F.xxhash64(F.lit(k), nulls, *columns) for k, n in enumerate(names)})


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one scan of one column, one number to the driver."""
    row = docs.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()
    return int(row.n or 0)


def parts_for(n_bytes: int, per_part: int, least: int = 8) -> int:
    return max(least, -(-n_bytes // per_part))


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data (uint8) and offsets (int64, n + 1) of a binary Arrow array without
    nulls; nothing is copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of at most ``limit`` bytes in
    ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = binary_column(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def merged_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join small Arrow batches (and cut large ones) to runs of about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in by_bytes(batches, column, limit):
        n = int(binary_column(part.column(column))[1][-1])
        if held and size + n > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.concat_batches(held)


def decoded(column: pa.Array) -> list[str]:
    """A binary column without nulls as text; bytes that are not UTF-8 are replaced
    (Spark does not check its strings)."""
    try:
        return column.cast(pa.string()).to_pylist()
    except pa.ArrowInvalid:
        return [x.as_py().decode("utf-8", "replace") for x in column]


SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def word_slices(body: bytes, size: int) -> Iterator[bytes]:
    """A text in slices of about ``size`` bytes that end with white space."""
    at = 0
    while len(body) - at > size:
        end = SPACE_BYTE.search(body, at + size)
        if end is None:
            break
        yield body[at:end.end()]
        at = end.end()
    yield body[at:] if at else body


# --- hashing -----------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return mix64(np.uint64(seed) + step * np.arange(1, n + 1, dtype=np.uint64))


def _base(seed: int) -> int:
    return int(seeded(1, seed)[0]) | 5


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 (mod 2^64) of an odd base and of its inverse."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = _base(seed)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[seed] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, seed: int) -> np.ndarray:
    """Rabin-Karp prefix sums: ``span_hash`` of any span follows from them."""
    power, _ = powers(seed, max(len(values), 1))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the values in [start, end), the same wherever the span lies."""
    _, inverse = powers(seed, len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


SEED = 21  # one base for all hashes: its tables of powers take memory in every worker
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_VALUES = seeded(256, 11)


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE,
                refine=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words (runs of bytes not in
    ``space``, by default ``[^\\x20\\x09-\\x0D]+``) of documents laid end to end,
    and each document's first word index (n + 1). ``refine(data, inside, edge)``
    may take further bytes out of words and set further edges between them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if refine is not None:
        refine(data, inside, edge)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, chunk: int = (1 << 20) - 1,
                values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of each word; bytes are taken in runs of about ``chunk``."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(int(np.searchsorted(end, start[at] + chunk, side="right")), at + 1)
        lo, hi = int(start[at]), int(end[stop - 1])
        pre = prefix_hash(values[data[lo:hi]], SEED)
        s, e = start[at:stop] - lo, end[at:stop] - lo
        out[at:stop] = mix64(span_hash(pre, s, e, SEED) + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    return out


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` word hashes (len - width + 1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pre = prefix_hash(words, seed)
    _, inverse = powers(seed, len(pre))
    return mix64((pre[width:] - pre[:n]) * inverse[:n])


def file_system(path: str):
    """pyarrow file system and path of a URI or local path."""
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_file(path: str, write) -> None:
    """Write a file by ``write(stream)`` under a name of this attempt, then
    move it in place: a lost or repeated task leaves no half file."""
    system, name = file_system(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    part = os.path.join(os.path.dirname(name), f"_{os.path.basename(name)}.{uuid.uuid4().hex[:8]}")
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, name)
