"""Exact top-k inner products over norm-sorted vectors.

Plan
----
1. Vectors become integers (JVM side); an orthogonal rotation that gathers the
   energy in the leading coordinates comes from the SVD of a bounded sample
   (``SAMPLE_ROWS`` rows; it steers the pruning, never the result).
2. Candidates are range-partitioned and sorted by falling length and packed
   into blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES``, written once where
   they were sorted; so are the queries, in blocks of at most ``QUERY_ROWS``.
3. Each query meets the block of the longest vectors first; its k-th score there
   is its threshold.
4. The blocks of candidates stay where they are. Query blocks are sent to them in
   rounds of ``ROUND_BYTES`` at most (a stated query set against all rows; what is
   broadcast has a proven bound); blocks whose longest possible product is below all
   thresholds of a round are not read. A task works through its blocks in order of
   length and carries the thresholds from longer to shorter ones: leading rotated
   coordinates give a partial sum, the Cauchy-Schwarz product of what is left bounds
   the rest; only rows that may still reach the threshold are scored exactly in
   integers, and the threshold rises.
5. At most k rows per query and task, ids and scores, go to the final ranking; no
   vector is shuffled for a pair of blocks.

Cases: rows without id, with a null vector, or with null or non-finite
components take no part; vectors of another dimension than the query's are not
compared with it; rows that repeat a candidate each count; rows with the
query's own id never do; repeated query rows count once; ties go to the smaller
id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm import common as C

K = 5
SCALE = 256
EVERY = 50
SAMPLE_ROWS = 4096
BLOCK_ROWS = 8192  # at most, and no more than BLOCK_BYTES of vectors
BLOCK_BYTES = 4 << 20
QUERY_ROWS = 1024
QUERY_STEP = 128
ROUND_BYTES = 16 << 20
FIRST_STEP, STEP = 64, 1024
LEAD = 0.25
FOUND = "query_id bigint, query_key bigint, vec_id bigint, score bigint"
FOUND_SCHEMA = pa.schema([(n, pa.int64()) for n in ("query_id", "query_key", "vec_id", "score")])


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) < float("inf")))
    ints = F.transform(x, lambda y: F.floor(y.cast("double") * float(scale)).cast("bigint"))
    return table.where(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                                                                   ints.alias("v"))


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose leading columns carry most of the sample."""
    d = sample.shape[1]
    if not len(sample) or not d:
        return np.eye(d)
    return np.linalg.svd(sample.T @ sample.astype(np.float64))[0]


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, dim) if dim else np.zeros((0, 0), np.int64)


def _pack(dim: int, rows: int):
    """Rows to packed blocks; the block number is filled in later."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, held = [], [], 0

        def block(i: np.ndarray, m: np.ndarray) -> dict:
            norm = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
            return {"ids": i.tobytes(), "vecs": m.tobytes(), "longest": float(norm.max())}
        schema = pa.schema([("ids", pa.binary()), ("vecs", pa.binary()), ("longest", pa.float64())])
        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy())
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            vecs.append(flat.reshape(-1, dim))
            held += len(ids[-1])
            if held >= rows:
                i, m = np.concatenate(ids), np.concatenate(vecs)
                cut = held // rows * rows
                yield pa.RecordBatch.from_pylist(
                    [block(i[a:a + rows], m[a:a + rows]) for a in range(0, cut, rows)], schema)
                ids, vecs, held = [i[cut:]], [m[cut:]], held - cut
        if held:
            yield pa.RecordBatch.from_pylist([block(np.concatenate(ids), np.concatenate(vecs))], schema)
    return run


class Search:
    """Top-k of query rows over candidate blocks met in order of falling length."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, turn: np.ndarray, k: int,
                 floor: np.ndarray | None = None) -> None:
        self.ids, self.vecs, self.k, self.turn = ids, vecs, k, turn
        self.lead = max(1, int(vecs.shape[1] * LEAD))
        turned = vecs @ turn
        self.front, self.rest = turned[:, :self.lead], np.sqrt((turned[:, self.lead:] ** 2).sum(axis=1))
        self.norm = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        none = np.zeros(0, np.int64)
        self.found = (none, none, none)  # query row, candidate id, score
        self.scored = 0

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        norm = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        ids, vecs, norm = ids[order], vecs[order], norm[order]
        turned = vecs @ self.turn
        front, rest = turned[:, :self.lead], np.sqrt((turned[:, self.lead:] ** 2).sum(axis=1))
        # few rows first: they raise the thresholds for all others
        steps = [0, *range(FIRST_STEP, len(ids), STEP)]
        for at, stop in zip(steps, [*steps[1:], len(ids)]):
            cut = slice(at, stop)
            for q in range(0, len(self.ids), QUERY_STEP):
                rows = np.arange(q, min(q + QUERY_STEP, len(self.ids)))
                slack = 0.5 + 1e-9 * self.norm[rows] * norm[at]
                rows = rows[self.norm[rows] * norm[at] + slack >= self.floor[rows]]
                if not len(rows):
                    continue
                bound = self.front[rows] @ front[cut].T
                bound += np.outer(self.rest[rows], rest[cut])
                bound += (0.5 + 1e-9 * self.norm[rows] * norm[at])[:, None]
                a, b = np.nonzero(bound >= self.floor[rows][:, None])
                a = rows[a]
                other = self.ids[a] != ids[cut][b]
                a, b = a[other], b[other]
                for s in range(0, len(a), 1 << 16):
                    x, y = a[s:s + (1 << 16)], b[s:s + (1 << 16)]
                    score = np.einsum("ij,ij->i", self.vecs[x], vecs[cut][y])
                    self.scored += len(x)
                    self._keep(x, ids[cut][y], score)

    def _keep(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor[rows]
        rows, ids, scores = (np.concatenate((old, new[good])) for old, new in zip(self.found, (rows, ids, scores)))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, rows)
        place = np.arange(len(rows)) - first
        kept = place < self.k
        self.found = rows[kept], ids[kept], scores[kept]
        last = place == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last])


def _floors(dim: int, turn: np.ndarray, k: int, top_ids: bytes, top_vecs: bytes):
    """Thresholds of a query block from the block of the longest vectors (one
    block, so of bounded size, sent with the function)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                search = Search(np.frombuffer(row["ids"], "<i8"), _matrix(row["vecs"], dim), turn, k)
                search.add(np.frombuffer(top_ids, "<i8"), _matrix(top_vecs, dim))
                need = np.where(search.norm > 0, search.floor / np.maximum(search.norm, 1e-300), -np.inf)
                need[(search.norm == 0) | (search.floor <= 0)] = -np.inf
                yield pa.RecordBatch.from_pylist([{
                    "q": row["q"], "ids": row["ids"], "vecs": row["vecs"], "floor": search.floor.tobytes(),
                    "reach": float(need.min()) * (1 - 1e-9)}])
    return run


def _search(dim: int, turn: np.ndarray, k: int, asked: list[tuple[bytes, bytes, bytes]]):
    """The query blocks of a round against the candidate blocks of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(np.frombuffer(ids, "<i8"), _matrix(vecs, dim), turn, k, np.frombuffer(floor))
                    for ids, vecs, floor in asked]
        for batch in batches:
            order = np.argsort(-batch.column("longest").to_numpy(), kind="stable").tolist()
            for i in order:
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                vecs = _matrix(batch.column("vecs")[i].as_py(), dim)
                for search in searches:
                    search.add(ids, vecs)
        for search in searches:
            rows, ids, scores = search.found
            # queries of one id with different vectors stay apart
            keys = (C.mix64(search.vecs.astype(np.uint64)) * C.seeded(dim, 5)).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (search.ids[rows], keys[rows], ids, scores)], schema=FOUND_SCHEMA)
    return run


def _rounds(floors: DataFrame) -> Iterator[tuple[float, list[tuple[bytes, bytes, bytes]]]]:
    """Query blocks of ``ROUND_BYTES`` at most (one at least), and the least length
    that matters to any of them; the driver holds one round."""
    sizes = floors.select("q", F.octet_length("vecs").alias("n")).orderBy("q").collect()  # a number per block
    held, size = [], 0
    lots: list[list[int]] = []
    for r in sizes:
        if held and size + r.n > ROUND_BYTES:
            lots.append(held)
            held, size = [], 0
        held.append(r.q)
        size += r.n
    if held:
        lots.append(held)
    for lot in lots:
        rows = floors.where(F.col("q").isin(lot)).orderBy("q").collect()
        yield min(r.reach for r in rows), [(bytes(r.ids), bytes(r.vecs), bytes(r.floor)) for r in rows]


def _top_of(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    turn = rotation(np.array([r.v for r in sample], np.int64).reshape(-1, dim))
    packed = "ids binary, vecs binary, longest double"
    block_rows = max(k + 1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    query_rows = max(1, min(QUERY_ROWS, BLOCK_BYTES // (8 * dim)))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n = vectors.count()
    parts = max(C.parts_for(n, 8 * block_rows, 1), min(C.parts_for(n, block_rows, 1), 64))
    dealt = vectors.withColumn("n", length).repartitionByRange(parts, F.col("n").desc(), "vec_id").sortWithinPartitions(
        F.col("n").desc(), "vec_id").select("vec_id", "v")
    spark = vectors.sparkSession
    path = C.work_dir(spark, "vector-blocks")
    dealt.mapInArrow(_pack(dim, block_rows), packed).write.parquet(path)
    blocks = spark.read.schema(packed).parquet(path)
    asked = queries.distinct()
    q_parts = C.parts_for(asked.count(), query_rows, 1)
    q_blocks = asked.repartition(q_parts, "vec_id").sortWithinPartitions("vec_id").mapInArrow(
        _pack(dim, query_rows), packed).drop("longest").withColumn("q", F.monotonically_increasing_id())
    # one block: the longest vectors
    top = blocks.orderBy(F.col("longest").desc(), F.xxhash64("ids")).select("ids", "vecs").first()
    floors = C.through_table(q_blocks.mapInArrow(_floors(dim, turn, k, bytes(top.ids), bytes(top.vecs)),
                                                 "q bigint, ids binary, vecs binary, floor binary, reach double"),
                             "query-blocks")
    path = C.work_dir(spark, "found")
    for reach, lot in _rounds(floors):
        near = blocks.where(F.col("longest") >= F.lit(reach))
        C.few_files(near.mapInArrow(_search(dim, turn, k, lot), FOUND)).write.mode("append").parquet(path)
    found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query.
    Both tables hold (vec_id, v); dimensions are worked through one by one."""
    vectors = C.through_table(vectors, "vectors")
    queries = C.through_table(queries, "queries")
    out = None
    for (dim,) in queries.select(F.size("v")).distinct().collect():
        if dim > 0:
            one = _top_of(vectors.where(F.size("v") == dim), queries.where(F.size("v") == dim), dim, k)
            out = one if out is None else out.union(one)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return out


def op7_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(C.read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0), K)
