"""Raw float32 vector files (headerless ``rows x dim``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# --- fixed values: vector dimension and element size of the raw file (must match the data) ---
DEFAULT_DIM = 1024
FLOAT_BYTES = 4
# --- end fixed values ---
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
FORMAT = "float32_matrix"


class ByteRange(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class VectorReader(DataSourceReader):
    """Whole records of a byte range as Arrow batches, decoded without a copy."""

    def __init__(self, options: dict) -> None:
        self.path = options["resolved"]
        self.size, self.record = int(options["size"]), FLOAT_BYTES * int(options["dim"])
        self.step = max(1, int(options["partitionbytes"]) // self.record) * self.record

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(at, min(at + self.step, self.size)) for at in range(0, self.size, self.step)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        system, name = fs.FileSystem.from_uri(self.path)
        dim = self.record // FLOAT_BYTES
        rows = max(1, BATCH_BYTES // self.record)
        with system.open_input_file(name) as source:
            source.seek(partition.start)
            at = partition.start
            while at < partition.end:
                data = source.read(min(rows * self.record, partition.end - at))
                n = len(data) // self.record
                if not n:
                    raise ValueError(f"{self.path}: shorter than it was")
                flat = pa.array(np.frombuffer(data[:n * self.record], "<f4"))
                first = at // self.record
                offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(offsets, flat)],
                    names=["vector_index", "embedding"])
                at += n * self.record


class VectorSource(DataSource):
    """``spark.read.format("float32_matrix")``: one input partition per byte range."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "vector_index bigint, embedding array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(dict(self.options))


def _located(spark: SparkSession, path: str) -> tuple[str, int]:
    """The file's resolved URI (mount tables and links followed) and its length."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(conf)
    uri = system.resolvePath(p).toUri().toString()
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return uri, int(system.getFileStatus(p).getLen())


def read_vectors(spark: SparkSession, path: str, dim: int = DEFAULT_DIM,
                 expected_rows: int | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(vector_index, embedding array<float>)`` from a raw float32 matrix.

    The file length must be a multiple of ``4*dim`` (and equal to
    ``4*dim*expected_rows`` when given), else ``ValueError``. The file is a Python
    data source: each task reads a byte range of whole records and hands Arrow
    batches to Spark; a record's place in the file is its row index.
    """
    uri, size = _located(spark, path)
    rec = FLOAT_BYTES * dim
    if size % rec != 0:
        raise ValueError(f"{path}: {size} bytes is not a multiple of {rec} (dim={dim})")
    if expected_rows is not None and size != rec * expected_rows:
        raise ValueError(f"{path}: expected {expected_rows} x {dim} float32, found {size // rec} rows")
    spark.dataSource.register(VectorSource)
    return spark.read.format(FORMAT).options(resolved=uri, size=size, dim=dim, partitionbytes=partition_bytes).load()


def align_vectors(vectors: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(appid, vector_index, embedding)``: vectors joined to the key map on
    ``vector_index`` (a keyed join, not row order)."""
    return mapping.join(vectors, "vector_index", "inner").select("appid", "vector_index", "embedding")


def build_embeddings_table(spark: SparkSession, vectors_path: str, map_path: str, out_path: str,
                           dim: int = DEFAULT_DIM) -> None:
    """Vector file + key map -> parquet embeddings table (one distributed write)."""
    from vitrine.sources.csv import read_embedding_map
    mapping = read_embedding_map(spark, map_path)
    vec = read_vectors(spark, vectors_path, dim)
    align_vectors(vec, mapping).write.mode("overwrite").parquet(out_path)


def check_dims(df: DataFrame, dim: int, col: str = "embedding") -> None:
    """Raise ``ValueError`` when any vector has another length (one count job)."""
    bad = df.where(F.size(col) != dim).limit(1).count()
    if bad:
        raise ValueError(f"{col}: vectors with a length other than {dim}")
