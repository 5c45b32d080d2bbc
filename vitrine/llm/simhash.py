"""SimHash near-dedup over a Gray-order hierarchical index.

Plan
----
1. ``mapInArrow``: one 64-bit fingerprint per text (XXH64, seed 42, of every
   shingle of ``shingle`` words; a bit is set if set in over half of them).
   Equal fingerprints collapse to one row with a partial aggregation.
2. Fingerprints that may lie within ``distance`` bits agree on some blocks of
   bits (pigeonhole); each fingerprint goes to one cell per choice of blocks.
   The number of blocks follows the number of fingerprints, so that a block
   value holds a few thousand of them; a block value that still holds more
   than ``CHUNK`` is split by salt into chunks, and every pair of its chunks is
   a cell. No cell is larger than two chunks, however hot the value.
3. Inside a task the cells are sorted by (cell, Gray rank). Runs of neighbours
   form nodes that factor out the bits all members share; runs of nodes form
   the upper levels. The search walks pairs of nodes from the top, adds up the
   differing bits that the nodes have in common, and drops the whole group once
   the sum exceeds ``distance``. Groups whose members are connected already
   are dropped too, so a dense family costs about its size, not its square;
   each cell returns a spanning forest, never all pairs.
4. Components of these links (:mod:`vitrine.llm.components`).

Cases: null and empty texts have fingerprint zero and are linked like any
other; a null ``doc_id`` never becomes a component id (a component of rows
without id has none); repeated rows are returned as they are; texts are hashed
in slices of ``SLICE`` bytes, so memory does not follow a very long text; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm.components import components

SHINGLE = 4
DISTANCE = 4
CHUNK = 4096
FANOUT = 8
SLAB = 1 << 13
CELL_ROWS = 1 << 17
SLICE = 1 << 19
SALTS = 16


# --- fingerprints --------------------------------------------------------------

def _votes(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """How many of the shingles of ``words`` set each bit, and how many there are."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[s:e], 42) for s, e in zip(starts, stops)], dtype="<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64), len(starts)


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    counts, n, held = np.zeros(64, np.int64), 0, []
    for part in C.word_slices(body, SLICE):
        words = held + part.lower().split()
        if len(words) >= shingle:
            votes, more = _votes(words, shingle)
            counts, n = counts + votes, n + more
            held = words[len(words) - shingle + 1:]
        else:
            held = words
    if not n:  # fewer words than a shingle has
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(held), 42)).astype(np.int64)) if held else 0
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(b.as_py(), shingle) for b in batch.column("body")], pa.int64())
            body = batch.schema.get_field_index("body")
            yield batch.set_column(body, "fp", values)
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, fp) for every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carry, C.text_bytes().alias("body"))
    kinds = ", ".join(f"{c} {k}" for c, k in rows.drop("body").dtypes)
    return rows.mapInArrow(_fingerprints(shingle), f"{kinds}, fp bigint")


# --- the index -----------------------------------------------------------------

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the binary-reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over codes sorted by (cell, Gray rank). A node knows the
    bits all its codes share (``same``), their values, and its range of cells."""

    def __init__(self, codes: np.ndarray, cells: np.ndarray) -> None:
        low, high = codes, codes
        first, last = cells, cells
        self.same, self.bits, self.first, self.last = [np.full(len(codes), ~np.uint64(0))], [codes], [cells], [cells]
        while len(low) > FANOUT:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            last = last[np.minimum(at + FANOUT, len(last)) - 1]
            first = first[at]
            same = ~(low ^ high)
            self.same.append(same)
            self.bits.append(low & same)
            self.first.append(first)
            self.last.append(last)
        self.labels = np.arange(len(codes))
        self._refresh()

    def _refresh(self) -> None:
        """Per node: the one component all its codes are in, or -1."""
        least = most = self.labels
        self.whole = [self.labels]
        for _ in self.same[1:]:
            at = np.arange(0, len(least), FANOUT)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.whole.append(np.where(least == most, least, -1))

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels
        while True:
            x, y = labels[a], labels[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = labels[labels]
                if np.array_equal(up, labels):
                    break
                labels[:] = up
        self._refresh()

    def link(self, distance: int) -> np.ndarray:
        """Connect all codes of one cell at ``distance`` bits or less; returns
        each code's component (the index of its first member)."""
        top = len(self.same) - 1
        a, b = np.triu_indices(len(self.same[top]))
        stack = [(top, a, b, None, None)]
        while stack:
            level, a, b, seen, spent = stack.pop()
            if len(a) > SLAB:
                rest = [None if x is None else x[SLAB:] for x in (a, b, seen, spent)]
                stack.append((level, *rest))
                a, b, seen, spent = [None if x is None else x[:SLAB] for x in (a, b, seen, spent)]
            common = self.same[level][a] & self.same[level][b]
            fresh = common if seen is None else common & ~seen
            total = np.bitwise_count((self.bits[level][a] ^ self.bits[level][b]) & fresh).astype(np.int16)
            if spent is not None:
                total += spent
            one = self.whole[level]
            keep = (total <= distance) & (self.first[level][b] <= self.last[level][a])
            keep &= (one[a] != one[b]) | (one[a] < 0)
            a, b, total, common = a[keep], b[keep], total[keep], common[keep]
            if not len(a):
                continue
            if level == 0:
                self._unite(a, b)
                continue
            below = len(self.same[level - 1])
            step = np.arange(FANOUT)
            x = np.repeat(a * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(step, FANOUT), len(a))
            y = np.repeat(b * FANOUT, FANOUT * FANOUT) + np.tile(step, len(a) * FANOUT)
            # a leaf is not compared with itself; a node is compared with itself once
            fits = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
            parent = np.repeat(np.arange(len(a)), FANOUT * FANOUT)[fits]
            x, y = x[fits], y[fits]
            near = y - x <= 1
            for part in (~near, near):
                if part.any():
                    up = parent[part]
                    stack.append((level - 1, x[part], y[part], common[up], total[up]))
        return self.labels


def link_cells(codes: np.ndarray, cells: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, code) of a spanning forest of each cell's links."""
    rank = gray_rank(codes)
    order = np.lexsort((rank, cells))
    codes, cells = codes[order], cells[order]
    labels = GrayIndex(codes, cells).link(distance)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return codes[moved], codes[labels[moved]]


def _search(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table, final: bool):
            cells = rows.column("cell").to_numpy()
            cut = len(cells) if final else int(np.searchsorted(cells, cells[-1]))
            codes = rows.column("fp").to_numpy()[:cut].view(np.uint64)
            a, b = link_cells(codes, cells[:cut], distance)
            return rows.slice(cut), pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= CELL_ROWS:
                rest, out = flush(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                yield out
        if held:
            yield flush(pa.Table.from_batches(held), True)[1]
    return run


def choices(n_codes: int, distance: int) -> list[int]:
    """Bit masks of which one at least agrees for any two codes at ``distance``
    bits: the bits are cut into ``distance`` + 1 or more blocks, as many as keep
    a mask's value at about ``CHUNK`` codes."""
    extra = 1
    while True:
        m = distance + extra
        bounds = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in range(m)]
        masks = [sum(blocks[i] for i in pick) for pick in combinations(range(m), extra)]
        if n_codes >> min(bin(x).count("1") for x in masks) <= CHUNK or extra == 4:
            return masks
        extra += 1


def links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``codes(fp)``, distinct, to edges (a, b): spanning forests of the pairs at
    ``distance`` bits or less."""
    if distance >= 64:
        raise ValueError("distance must be below 64")
    masks = choices(codes.count(), distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = codes.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("t", "v")).select(
        "fp", F.xxhash64("t", "v").alias("k"))
    hot = keyed.groupBy("k").count().where(F.col("count") > CHUNK).select(
        "k", F.ceil(F.col("count") / CHUNK).cast("int").alias("n"))
    salt = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    celled = keyed.join(hot, "k", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("s", salt).select(
        "fp", "k", "s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")).select(
        "fp", F.xxhash64("k", F.least("s", "j"), F.greatest("s", "j")).alias("cell"))
    return celled.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        _search(distance), "a bigint, b bigint")


def groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
           carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's fingerprint (doc_id, *carry, fp), the distinct fingerprints with
    their smallest id (fp, least), and the fingerprints of groups of more than one
    (fp, root); a fingerprint that is not among them is a group of its own."""
    prints = C.through_table(fingerprints(docs, shingle, carry), "fingerprints")
    codes = C.through_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    stars = components(links(codes.select("fp"), distance))
    rooted = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    return prints, codes, rooted


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; ``component_id`` is
    the smallest id reachable over links of ``distance`` bits or less."""
    prints, codes, rooted = groups(docs, shingle, distance)
    linked = rooted.join(codes, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    # a large component's codes meet its smallest id in several tasks
    least = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    named = linked.join(least, ["root", "salt"]).select("fp", "component_id")
    alone = codes.join(rooted, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return prints.join(named.union(alone), "fp").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, key: tuple[str, ...], shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The ``key`` (columns that tell rows apart) of one row of each group: the
    smallest id (none comes last), of equal ids the smallest key."""
    prints, _, rooted = groups(docs, shingle, distance, key)
    grouped = prints.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *key)).alias("s"))
    return first.select(*[F.col("s")[k].alias(k) for k in key])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.read_table(spark, sf_dir, "documents"), SHINGLE, DISTANCE)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
