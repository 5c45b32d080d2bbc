"""Best-fit packing by minimum bin slack.

Plan
----
1. ``mapInArrow``: texts to token ids; only a document longer than a sequence is
   cut, its first piece taking the remainder. The pieces (not the texts) are
   written once to the shared folder.
2. The histogram of piece lengths (one row per length, so as many rows as a
   sequence has tokens whatever the corpus) goes to the driver, where each bin
   is filled by a bitset subset-sum over the lengths still there, starting with
   the longest one; the fullest combination is taken out as often as its lengths
   allow at once, so the work follows the number of different combinations.
3. Each piece gets its rank among the pieces of its length. Ranks are numbered
   within salted groups and shifted by the groups' counts, so a length that a
   third of all pieces share is not numbered in one task. The rank falls into a
   run of equal bins, which gives sequence and offset.

Cases: null or empty texts are one piece with the end id alone; bytes that are not
UTF-8 are replaced before they are encoded; a text of any length is encoded whole, by
itself, and cut; a null ``doc_id`` and repeated rows are packed like any other; pieces of
one length are interchangeable, their order follows salted ranks; an empty table gives
no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import tokens as T

SIZE = 1024
RANK_GROUP = 2_000
TEXT_BYTES = 1 << 21


# --- pieces ----------------------------------------------------------------------

def _pieces(path: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = T.encoder(path), T.end_mark(end_id)
        for batch in C.by_bytes(batches, "body", TEXT_BYTES):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            texts = C.decoded(batch.column("body"))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.ids(texts)):
                ids += end
                n, at, number = len(ids) // 4, 0, 0
                take = (n - 1) % size + 1
                while at < n:
                    part = ids[4 * at:4 * (at + take)]
                    for key, value in zip(out, (doc, number, at, take, zlib.crc32(part), part if with_ids else None)):
                        out[key].append(value)
                    at, number, take = at + take, number + 1, size
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                                                           pa.int64(), pa.binary()))], list(out))
    return run


def pieces(docs: DataFrame, path: str, end_id: int = T.END_ID, size: int = SIZE,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the token pieces of at
    most ``size`` ids; ``ids`` (little-endian uint32) only on request."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), C.text_bytes().alias("body"))
    return rows.mapInArrow(_pieces(path, end_id, size, with_ids),
                           "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


# --- minimum bin slack -----------------------------------------------------------

def fullest(counts: np.ndarray, lengths: list[int], room: int) -> dict[int, int]:
    """Lengths (with copies) whose sum comes closest to ``room``: a bitset of
    reachable sums per length, read back from the largest sum."""
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in lengths:
        if length > room or not counts[length]:
            continue
        steps.append((length, reach))
        moved = reach
        for _ in range(min(int(counts[length]), room // length)):
            moved = (moved << length) & mask
            if not moved:
                break
            reach |= moved
        if reach & goal:
            break
    left, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        copies = 0
        while not before >> left & 1:
            left -= length
            copies += 1
        if copies:
            taken[length] = copies
    return taken


def minimum_bin_slack(counts: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """``counts[length]`` to (combination, how many bins of it)."""
    counts = counts.astype(np.int64).copy()
    bins = []
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        taken = fullest(counts, lengths, size - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(int(counts[x]) // n for x, n in taken.items())
        for x, n in taken.items():
            counts[x] -= n * times
        bins.append((taken, times))
        lengths = [x for x in lengths if counts[x]]
    return bins


def layout(bins: list[tuple[dict[int, int], int]], size: int) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, copies a bin, first bin, offset) sorted by rank."""
    rows: dict[int, list] = {}
    ranks = np.zeros(size + 1, np.int64)
    first = 0
    for taken, times in bins:
        at = 0
        for length in sorted(taken, reverse=True):
            rows.setdefault(length, []).append((ranks[length], taken[length], first, at))
            ranks[length] += taken[length] * times
            at += length * taken[length]
        first += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place(plan: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                here = np.flatnonzero(length == size)
                rows = plan[int(size)]
                run_of = rows[np.searchsorted(rows[:, 0], rank[here], side="right") - 1]
                step = rank[here] - run_of[:, 0]
                sequence[here] = run_of[:, 2] + step // run_of[:, 1]
                offset[here] = run_of[:, 3] + step % run_of[:, 1] * size
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])
    return run


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (a written table with doc_id, piece and length) with
    ``sequence_id`` and ``offset``."""
    counts = np.zeros(size + 1, np.int64)
    for row in parts.groupBy("length").count().collect():
        counts[row[0]] = row[1]
    plan = layout(minimum_bin_slack(counts, size), size)
    salts = C.parts_for(int(counts.sum()), RANK_GROUP, 1)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("local", local).join(before, ["length", "salt"]).select(
        *parts.columns, (F.col("before") + F.col("local") - 1).alias("rank"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(_place(plan), f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from pieces made ``with_ids``."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(joined, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(whole.alias("ids"))


def best_fit_packing(docs: DataFrame, path: str, size: int = SIZE, end_id: int = T.END_ID,
                     with_ids: bool = False) -> DataFrame:
    parts = pieces(docs, path, end_id, size, with_ids)
    return pack(C.through_table(parts if with_ids else parts.drop("ids"), "pieces"), size)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    out = best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), SIZE)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
