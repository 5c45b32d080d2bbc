"""Vector codes: product quantization with Orchard search for the nearest entry.

Plan
----
1. Components become integers floor(``scale`` * x) (JVM side), written once as
   thin rows; the first ``entries`` ids give every part's first codebook.
2. Each round is one map-only pass: a task assigns the parts of its vectors and
   sends one sum and count per part and entry (parts x entries rows a task, summed
   again by Spark), so the driver gets one row per part and entry, whatever the
   number of vectors.
3. A last pass assigns again and writes code and error; errors are summed per
   label by a partial aggregation and joined back (a hot label's rows stay spread:
   adaptive execution may split that join).

Orchard search: each entry holds the list of all others by distance from it. A part
starts at some entry and walks that entry's list; a closer entry (or an equally
close one of lower index) takes its place and the walk goes on in the new entry's
list; entries met before are marked and not measured again; it ends at the first
entry that lies beyond twice the current distance (strictly, so that ties are still
met). All parts of a batch walk at once.

Cases: a vector that is null, empty, or holds null or non-finite components takes no
part, nor does one of another length than the smallest id's vector, or one whose
integers are so large that its squared distances do not fit a long (beyond
``limit(dim)``); that length must be a multiple of the parts, otherwise vectors of
the smallest id of a fitting length count. Fewer ids than entries give a smaller
codebook; of repeated ids the smallest vector starts it, and every row is coded;
rows without id are coded and start a codebook last; null labels are one label;
an empty table gives no rows; other columns are ignored. Distances and errors are
exact integers; a label's sum that does not fit a long is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
STEP = 1 << 14  # parts that walk at once


def limit(dim: int) -> int:
    """Largest component so that dim squared differences fit a long."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def integer_parts(table: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, written once, and their length."""
    x = F.col("embedding")
    fits = (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(
        x, lambda y: y.isNotNull() & ~F.isnan(y.cast("double"))
        & (F.abs(y.cast("double") * float(scale)) < F.lit(2.0 ** 62)))
    ints = F.transform(x, lambda y: F.floor(y.cast("double") * float(scale)).cast("bigint"))
    rows = table.where(x.isNotNull() & fits).select("vec_id", "label", ints.alias("v"))
    largest = F.array_max(F.transform("v", lambda y: F.abs(y)))
    bounds = F.floor(F.sqrt(F.lit(2.0 ** 62) / F.size("v")) / 2)  # = limit()
    rows = C.through_table(rows.where(largest < bounds), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    return rows, first[0] if first else 0


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Entries x parts x length of a part: the vectors of the smallest ids. Each
    pass is a top-k of ``entries`` rows a task; only repeated ids need another one."""
    found: dict = {}
    rest = rows
    while len(found) < entries:
        some = rest.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("vec_id", "v").limit(entries).collect()
        for r in some:
            if len(found) < entries:
                found.setdefault(r.vec_id, r.v)
        if len(some) < entries or some[-1].vec_id is None:
            break
        rest = rows.where(F.col("vec_id").isNull() | (F.col("vec_id") > F.lit(some[-1].vec_id)))
    length = len(next(iter(found.values()), ())) // parts
    return np.array(list(found.values()), np.int64).reshape(len(found), parts, length)


class Orchard:
    """Nearest entries in a codebook per part, entries x parts x length."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = np.ascontiguousarray(books.transpose(1, 0, 2))  # parts x entries x length
        diff = self.books[:, :, None, :] - self.books[:, None, :, :]
        self.apart = np.einsum("pabl,pabl->pab", diff, diff)
        n = books.shape[0]
        order = np.argsort(self.apart, axis=2, kind="stable")
        # every entry's list of the others, nearest first
        self.lists = order[order != np.arange(n)[None, :, None]].reshape(books.shape[1], n, n - 1)
        self.far = np.take_along_axis(self.apart, self.lists, axis=2)
        self.sums = self.books.sum(axis=2)
        self.measured = 0

    def _distance(self, x: np.ndarray, part: np.ndarray, entry: np.ndarray) -> np.ndarray:
        self.measured += len(x)
        diff = x - self.books[part, entry]
        return np.einsum("ij,ij->i", diff, diff)

    def nearest(self, x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row of ``x``, a vector of that part."""
        entry = np.empty(len(x), np.int64)
        distance = np.empty(len(x), np.int64)
        for at in range(0, len(x), STEP):
            cut = slice(at, at + STEP)
            entry[cut], distance[cut] = self._walk(x[cut], part[cut])
        return entry, distance

    def _walk(self, x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.books.shape[1]
        rows = np.arange(len(x))
        # start where the sum of the components is nearest
        here = np.abs(self.sums[part] - x.sum(axis=1)[:, None]).argmin(axis=1)
        best = self._distance(x, part, here)
        marks = np.zeros((len(x), n), bool)
        marks[rows, here] = True
        place = np.zeros(len(x), np.int64)
        active = rows if n > 1 else rows[:0]
        while len(active):
            a, b, p = part[active], here[active], place[active]
            near = self.far[a, b, p] <= 4 * best[active]  # not beyond twice the distance
            active = active[near]
            if not len(active):
                break
            other = self.lists[a[near], b[near], p[near]]
            place[active] += 1
            new = ~marks[active, other]
            test, other = active[new], other[new]
            marks[test, other] = True
            d = self._distance(x[test], part[test], other)
            better = (d < best[test]) | ((d == best[test]) & (other < here[test]))
            moved = test[better]
            here[moved], best[moved], place[moved] = other[better], d[better], 0
            active = active[place[active] < n - 1]
        return here, best


def _flat(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of all vectors of a batch as rows, and each row's part."""
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    n = batch.num_rows
    return v.reshape(n * parts, -1), np.tile(np.arange(parts), n)


def _sums(books: np.ndarray):
    entries, parts, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(books)
        total = np.zeros((parts * entries, length), object)
        count = np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, part = _flat(batch, parts)
            cell = part * entries + search.nearest(x, part)[0]
            order = np.argsort(cell, kind="stable")
            seen, first = np.unique(cell[order], return_index=True)
            # batches are small enough for longs (limit() leaves 2 bits and more a row), totals are exact
            for s in range(length):
                high, low = x[order, s] >> 32, x[order, s] & 0xFFFFFFFF
                h, w = np.add.reduceat(high, first), np.add.reduceat(low, first)
                total[seen, s] += h.astype(object) * (1 << 32) + w.astype(object)
            count[seen] += np.diff([*first, len(cell)])
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int64()),
            pa.array([[int(t) >> 32 for t in total[u]] for u in used], pa.list_(pa.int64())),
            pa.array([[int(t) & 0xFFFFFFFF for t in total[u]] for u in used], pa.list_(pa.int64())),
            pa.array(count[used])], names=["cell", "high", "low", "n"])
    return run


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part assigned, every used entry replaced by the floor of
    its parts' mean."""
    entries, parts, length = books.shape
    sums = rows.select("v").mapInArrow(_sums(books), "cell bigint, high array<bigint>, low array<bigint>, n bigint")
    wide = "decimal(38,0)"
    cells = sums.groupBy("cell").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("high")[s].cast(wide) * F.lit(1 << 32).cast("decimal(11,0)")
                                       + F.col("low")[s].cast("decimal(19,0)")).alias(f"s{s}")
                                 for s in range(length)]).collect()
    new = books.copy()
    for r in cells:
        part, entry = divmod(r.cell, entries)
        new[entry, part] = [int(r[f"s{s}"]) // r.n for s in range(length)]
    return new


def train(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    books = first_books(rows, parts, entries)
    for _ in range(rounds if len(books) else 0):
        books = next_books(rows, books)
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    flat = books.transpose(1, 0, 2).ravel().tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def _codes(books: np.ndarray):
    entries, parts, _ = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(books)
        for batch in batches:
            x, part = _flat(batch, parts)
            entry, distance = search.nearest(x, part)
            codes = entry.astype(np.uint8).reshape(-1, parts)
            raw = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"),
                pa.array([raw[a:a + 2 * parts] for a in range(0, len(raw), 2 * parts)], pa.string()),
                pa.array(distance.reshape(-1, parts).sum(axis=1))], names=["vec_id", "label", "code", "error"])
    return run


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_codes(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    parts = books.shape[1]
    entry = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(-1, parts)
    return books[entry, np.arange(parts)].reshape(len(codes), -1)


def vector_codes(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The coded rows (vec_id, label, code, error) of ``table`` (vec_id, embedding,
    label), written once, and the codebooks (entries x parts x length)."""
    if entries > 256:
        raise ValueError("a code has one byte per part")
    rows, dim = integer_parts(table, parts, scale)
    rows = rows.where(F.size("v") == dim)
    books = train(rows, parts, entries, rounds)
    if not len(books):
        kinds = dict(rows.dtypes)
        schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
        return table.sparkSession.createDataFrame([], schema), books
    return C.through_table(encode(rows, books), "codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(C.read_table(spark, sf_dir, "embeddings"))
    sums = coded.groupBy("label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    same = coded["label"].eqNullSafe(sums["label"])
    return C.few_files(coded.join(sums, same).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")))
