"""Token-ID output as directly addressable codes.

File format (little-endian), one file per segment of documents in ascending
``doc_id`` order:

* header: magic ``DACTOK01``, then uint64: number of tokens, of documents, of
  levels; then the documents' ids (int64) and lengths (uint64);
* per level a directory entry of uint64: number of chunks, places of the three
  parts; then the parts: the chunks (one byte of each id that reaches the
  level), a bitmap with 1 where an id goes on in the next level, and a rank
  directory (uint64: ones before each run of ``RUN`` bits).

An id's chunk in the next level stands at the rank of its bit, so any token is
read with one chunk, one bit and one rank per level; no block is decoded.

Plan: range partitioning by ``doc_id`` (sampled by Spark), sorting inside the
partitions, then ``mapInArrow`` encodes and writes segments of bounded size; a
file is written under an attempt's own name and moved in place, so a repeated
task replaces its files by equal ones. The small table of segments gives each
one's first token by a window inside the partitions and one over partition
totals. The files are then read back, segment by segment.

Cases: null or empty texts are the end id alone; bytes that are not UTF-8 are replaced
before they are encoded; a text of any length is encoded whole, by itself; rows without
``doc_id`` come first; rows of equal id are ordered by the hash of their texts; other
columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import tokens as T

MAGIC = b"DACTOK01"
RUN = 512
SEGMENT_TOKENS = 1 << 22
PARTITION_BYTES = 1 << 25
TEXT_BYTES = 1 << 21
NO_ID = -(1 << 63)  # stands for a null doc_id in a file
SEGMENTS = "part int, segment int, path string, documents bigint, tokens bigint"


# --- the codes -----------------------------------------------------------------

def levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) per level of one-byte chunks."""
    out, rest = [], ids.astype("<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RUN), dtype=np.int64) if len(more) else np.zeros(0, int)
        out.append(((rest & 255).astype(np.uint8), bits, (np.cumsum(ones) - ones).astype("<u8")))
        rest = rest[more] >> 8
        if not len(rest):
            return out


def write_codes(stream, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
    parts = levels(ids)
    head = MAGIC + struct.pack("<3Q", len(ids), len(doc_ids), len(parts))
    head += doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes()
    at, entries = len(head) + 32 * len(parts), []
    for level in parts:
        sizes = [x.nbytes for x in level]
        entries.append((len(level[0]), at, at + sizes[0], at + sizes[0] + sizes[1]))
        at += sum(sizes)
    stream.write(head + b"".join(struct.pack("<4Q", *e) for e in entries))
    for level in parts:
        for x in level:
            stream.write(x.tobytes())


class TokenFile:
    """Random access to the ids of one segment; ``read(place, size)`` gives bytes."""

    def __init__(self, read) -> None:
        self.read = read
        if read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.n_tokens, self.n_docs, n_levels = struct.unpack("<3Q", read(8, 24))
        at = 32
        self.doc_ids = np.frombuffer(read(at, 8 * self.n_docs), "<i8")
        self.lengths = np.frombuffer(read(at + 8 * self.n_docs, 8 * self.n_docs), "<u8").astype(np.int64)
        at += 16 * self.n_docs
        self.levels = [struct.unpack("<4Q", read(at + 32 * i, 32)) for i in range(n_levels)]

    def _bits(self, level: int, start: int, end: int) -> np.ndarray:
        first = start // 8
        raw = np.frombuffer(self.read(self.levels[level][2] + first, (end + 7) // 8 - first), np.uint8)
        return np.unpackbits(raw, bitorder="little")[start - 8 * first:end - 8 * first].astype(bool)

    def rank(self, level: int, at: int) -> int:
        """Ones of the level's bitmap before bit ``at``."""
        block = at // RUN
        (before,) = struct.unpack("<Q", self.read(self.levels[level][3] + 8 * block, 8))
        return before + int(self._bits(level, block * RUN, at).sum())

    def __len__(self) -> int:
        return self.n_tokens

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1."""
        out = np.zeros(max(end - start, 0), "<u4")
        place = np.arange(len(out))
        for level, (_, chunks, _, _) in enumerate(self.levels):
            if not len(place):
                break
            out[place] |= np.frombuffer(self.read(chunks + start, end - start), np.uint8).astype("<u4") << (8 * level)
            more = self._bits(level, start, end)
            place = place[more]
            if len(place):
                start = self.rank(level, start)
                end = start + len(place)
        return out

    def token(self, at: int) -> int:
        return int(self.tokens(at, at + 1)[0])


def open_codes(path: str) -> TokenFile:
    """A segment opened for random access on any file system."""
    system, name = C.file_system(path)
    source = system.open_input_file(name)

    def read(place: int, size: int) -> bytes:
        return source.read_at(size, place)
    return TokenFile(read)


# --- jobs ----------------------------------------------------------------------

def _write(folder: str, path: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part = T.encoder(path), T.end_mark(end_id), TaskContext.get().partitionId()
        docs: list[int] = []
        held: list[bytes] = []
        size = segment = 0

        def flush() -> pa.RecordBatch:
            name = os.path.join(folder, f"part-{part:06d}-{segment:06d}.dac")
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            C.write_file(name, lambda out: write_codes(out, np.array(docs, np.int64), lengths, ids))
            return pa.RecordBatch.from_pylist(
                [{"part": part, "segment": segment, "path": name, "documents": len(docs), "tokens": len(ids)}],
                pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("path", pa.string()),
                           ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in C.by_bytes(batches, "body", TEXT_BYTES):
            texts = C.decoded(batch.column("body"))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.ids(texts)):
                docs.append(NO_ID if doc is None else doc)
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= segment_tokens:
                    yield flush()
                    docs, held, size, segment = [], [], 0, segment + 1
        if held:
            yield flush()
    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = T.END_ID,
                      segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Write the ids of all texts below ``folder``; returns the segments with
    ``base``, the number of ids before each."""
    parts = C.parts_for(C.total_bytes(docs), PARTITION_BYTES)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"),
                       C.text_bytes().alias("body"))
    dealt = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    segments = C.through_table(
        dealt.select("doc_id", "body").mapInArrow(_write(folder, path, end_id, segment_tokens), SEGMENTS), "segments")
    inside = Window.partitionBy("part").orderBy("segment")
    totals = segments.groupBy("part").agg(F.sum("tokens").alias("n"))
    first = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    return segments.withColumn("within", F.sum("tokens").over(inside) - F.col("tokens")).join(first, "part").select(
        "part", "segment", "path", "documents", "tokens", (F.col("first") + F.col("within")).alias("base"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            system, name = C.file_system(path)
            with system.open_input_file(name) as source:
                whole = memoryview(source.read())
            file = TokenFile(lambda place, size, whole=whole: bytes(whole[place:place + size]))
            ends = np.cumsum(file.lengths)
            starts = ends - file.lengths
            crc = [zlib.crc32(file.tokens(s, e).tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.doc_ids, mask=file.doc_ids == NO_ID), pa.array(base + starts),
                 pa.array(file.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    n = max(1, segments.count())
    return segments.select("path", "base").repartition(min(n, 10_000), "path").mapInArrow(
        _read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    segments = write_token_files(docs, C.work_dir(spark, "token-codes"), public_tokenizers.path("word_bpe_49k.json"))
    return C.few_files(read_token_files(segments))
