"""Substring dedup: Rabin-Karp hashes of every fixed-length token window,
counted in Spark; repeated windows merge into maximal removal intervals.

Plan
----
1. ``mapInArrow`` over the texts: every window of ``width`` words gets a
   64-bit Rabin-Karp hash; a second hash deals the windows to buckets. The
   windows of a block of documents that a smaller document of the same block
   already has are decided there (map-side combine: a window that a third of
   all documents share reaches its bucket once per block, not per document).
   The others leave as packets: per block and bucket the documents' ids and
   eight bytes a window, positions as one-byte gaps.
2. ``groupBy(bucket)``: the windows of a bucket are sorted by hash; those whose
   smallest document is another one are to be removed.
3. The marks go on as one row per bucket and part of the documents (not per
   document), are gathered to one row per document, joined to the texts, merged
   into maximal intervals and cut out.

The number of buckets follows the size of the input, so one bucket holds
about ``BUCKET_BYTES`` of text whatever the total. Equality is decided on 64
bits plus the independent bucket number.

Cases: null or empty texts have no words; a row without ``doc_id`` is neither
smaller nor larger than any other, so it keeps all its words and removes none
elsewhere; rows with the same ``doc_id`` do not remove each other's words and
are judged one by one; an empty table gives an empty result; other columns are
ignored unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import packets as P

WIDTH = 13
BLOCK_BYTES = 1 << 21
CUT_BYTES = 1 << 22
SLICE = 1 << 19
BUCKET_BYTES = 20 << 20
PACKET = "bucket int, kind int, ids binary, keys binary, counts binary, gaps binary, wide binary, hashes binary"
MARKS = "doc_id bigint, doc_key bigint, marks binary"


def _packet(bucket: int, kind: int, rows: np.ndarray, positions: np.ndarray, hashes: np.ndarray | None,
            ids: np.ndarray, keys: np.ndarray) -> dict:
    """One row: ``rows`` (rising) are the documents of the block."""
    docs, first = P.documents_of(rows, ids, keys)
    gaps, wide = P.pack_positions(positions, first, "u1")
    return {"bucket": bucket, "kind": kind, **docs, "gaps": gaps, "wide": wide,
            "hashes": b"" if hashes is None else hashes.tobytes()}


def _views(block: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes and offsets of a block's texts, and the number of words before them; a
    very long text (a block of its own) in slices that overlap by a window."""
    data, offsets = C.binary_column(block.column("body"))
    if block.num_rows > 1 or len(data) <= 2 * BLOCK_BYTES:
        yield data, offsets, 0
        return
    at = base = 0
    size = 2 * BLOCK_BYTES
    while True:
        end = min(at + size, len(data))
        while end < len(data) and not C.IS_SPACE[data[end]]:
            step = data[end:end + 4096]
            space = np.flatnonzero(C.IS_SPACE[step])
            end += int(space[0]) if len(space) else len(step)
        part = data[at:end]
        start = C.word_bounds(part, np.array([0, len(part)]))[0]
        if end < len(data) and len(start) < width:
            size *= 2  # a few very long words
            continue
        yield part, np.array([0, len(part)]), base
        if end >= len(data):
            return
        at, base, size = at + int(start[1 - width]), base + len(start) - width + 1, 2 * BLOCK_BYTES


def _window_packets(width: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [
        (n, pa.binary()) for n in ("ids", "keys", "counts", "gaps", "wide", "hashes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.merged_batches(batches, "body", BLOCK_BYTES):
            ids = block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = (block.column("doc_key").to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF).astype("<u4")
            for data, offsets, base in _views(block, width):
                start, end, first = C.word_bounds(data, offsets)
                if len(start) < width:
                    continue
                words = C.word_hashes(data, start, end)
                doc = np.repeat(np.arange(len(ids)), np.diff(first))
                n = len(words) - width + 1
                whole = np.flatnonzero(doc[:n] == doc[width - 1:])
                if not len(whole):
                    continue
                h = C.window_hashes(words, width, C.SEED)[whole]
                deal = ((C.window_hashes(words, width, 37)[whole] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                doc = doc[whole]
                pos = whole - first[doc] + base
                order = np.argsort(h)
                edge = np.concatenate(([True], h[order][1:] != h[order][:-1]))
                owner = ids[doc[order]]
                least = np.minimum.reduceat(owner, np.flatnonzero(edge))[np.cumsum(edge) - 1]
                known = np.zeros(len(h), bool)
                known[order] = owner > least
                out = []
                here = np.flatnonzero(known)
                if len(here):
                    out.append(_packet(int(ids[0]) % buckets, 1, doc[here], pos[here], None, ids, keys))
                sent = np.flatnonzero(~known)
                sent = sent[np.argsort(deal[sent], kind="stable")]
                cuts = np.searchsorted(deal[sent], np.arange(buckets + 1))
                for b in range(buckets):
                    part = sent[cuts[b]:cuts[b + 1]]
                    if len(part):
                        out.append(_packet(b, 0, doc[part], pos[part], h[part], ids, keys))
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def _mark_repeated(table: pa.Table, parts: int) -> pa.Table:
    """One bucket: marks of the windows a smaller document has too, and the
    marks already decided in the blocks. About 35 bytes are held a window."""
    def column(name: str) -> list[bytes]:
        return [x.as_py() for x in table.column(name)]

    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in column("counts")]
    sizes = np.array([x.sum() for x in counts])
    total = int(sizes.sum())
    pos = np.empty(total, np.int32)
    at = 0
    for c, g, w in zip(counts, column("gaps"), column("wide")):
        n = int(c.sum())
        pos[at:at + n] = P.unpack_positions(g, w, c, "u1")
        at += n
    counts = np.concatenate(counts)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    ids, keys = P.join_column(table, "ids", "<i8"), P.join_column(table, "keys", "<u4")
    marked = np.repeat(np.array(table.column("kind").to_pylist(), np.int8) == 1, sizes)
    asked = np.flatnonzero(~marked).astype(np.int32)
    hashes = P.join_column(table, "hashes", "<u8")
    order = np.argsort(hashes)
    hashes = hashes[order]
    equal = np.zeros(len(order) + 1, bool)
    equal[1:-1] = hashes[1:] == hashes[:-1]
    shared = np.flatnonzero(equal[1:] | equal[:-1])  # windows that occur more than once
    if len(shared):
        edge = ~equal[shared]
        place = asked[order[shared]]
        owner = ids[row[place]]
        least = np.minimum.reduceat(owner, np.flatnonzero(edge))[np.cumsum(edge) - 1]
        marked[place[owner > least]] = True
    hit = np.flatnonzero(marked)
    return P.to_parts(row[hit], pos[hit], ids, keys, parts)


def _cut(width: int, digest: bool, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.by_bytes(batches, "body", CUT_BYTES):
            bodies, marks = batch.column("body"), batch.column("marks")
            out = {k: [] for k in ("n_words", "n_removed", "span_starts", "span_ends", "kept")}
            for i in range(batch.num_rows):
                body, places = bodies[i].as_py(), marks[i].as_py()
                starts = ends = np.zeros(0, np.int64)
                gone = None
                if places:
                    places = np.frombuffer(places, "<i4")  # each place once
                    edge = np.zeros(int(places.max()) + width + 1, np.int32)
                    edge[places] += 1
                    edge[places + width] -= 1
                    gone = np.cumsum(edge) > 0  # words beyond its end stay
                    step = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
                    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                n_words, n_kept, pieces = 0, 0, []
                for part in C.word_slices(body, SLICE):
                    words = part.split()
                    here = None if gone is None else gone[n_words:n_words + len(words)]
                    n_words += len(words)
                    if here is not None and here.any():
                        stay = np.ones(len(words), bool)
                        stay[:len(here)] = ~here
                        words = list(compress(words, stay.tolist()))
                    n_kept += len(words)
                    if words:
                        pieces.append(b" ".join(words))
                text = b" ".join(pieces)
                out["n_words"].append(n_words)
                out["n_removed"].append(n_words - n_kept)
                out["span_starts"].append(starts)
                out["span_ends"].append(ends)
                out["kept"].append(hashlib.sha256(text).hexdigest() if digest else text)
            names = carried + list(out)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried] + [pa.array(v, t) for v, t in zip(out.values(), kinds)], names)
    return run


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, doc_key, marks): start positions (packed int32) of the windows
    that also start in a document with a smaller id."""
    buckets = C.parts_for(C.total_bytes(docs), BUCKET_BYTES)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("doc_key"),
        C.text_bytes().alias("body"))
    packets = rows.mapInArrow(_window_packets(width, buckets), PACKET)
    def mark(table: pa.Table) -> pa.Table:
        return _mark_repeated(table, buckets)
    return packets.groupBy("bucket").applyInArrow(mark, P.PARTS).groupBy("part").applyInArrow(P.gather(1), MARKS)


def substring_dedup(docs: DataFrame, width: int = WIDTH, carry: tuple[str, ...] = ("doc_id",),
                    digest: bool = False) -> DataFrame:
    """Cut every word that a repeated window covers.

    ``docs`` needs ``doc_id`` and ``text``; returns the ``carry`` columns, then
    ``n_words``, ``n_removed``, ``span_starts`` / ``span_ends`` (word positions of
    the maximal removed intervals, end exclusive) and ``kept``: the words left,
    joined by one space, or with ``digest`` their SHA-256.
    """
    marks = repeated_windows(docs, width).withColumnsRenamed({"doc_id": "__id", "doc_key": "__key"})
    carried = [f"__c{i}" for i in range(len(carry))]
    whole = docs.select(*[F.col(c).alias(a) for c, a in zip(carry, carried)],
                        F.col("doc_id").cast("bigint").alias("__doc"),
                        F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("__doc_key"),
                        C.text_bytes().alias("body"))
    joined = whole.join(marks, (F.col("__doc") == F.col("__id")) & (F.col("__doc_key") == F.col("__key")), "left")
    schema = ", ".join([f"{a} {joined.schema[a].dataType.simpleString()}" for a in carried] + [
        "n_words bigint", "n_removed bigint", "span_starts array<bigint>", "span_ends array<bigint>",
        "kept string" if digest else "kept binary"])
    done = joined.select(*carried, "body", "marks").mapInArrow(_cut(width, digest, carried), schema)
    back = [F.col(a).alias(c) for a, c in zip(carried, carry)]
    kept = F.col("kept") if digest else F.col("kept").cast("string").alias("kept")
    return done.select(*back, "n_words", "n_removed", "span_starts", "span_ends", kept)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    out = substring_dedup(docs, WIDTH, digest=True)
    return C.few_files(out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256")))
