"""An opt-in index of vectors in coarse cells, for many queries over large catalogs.

:func:`vitrine.operators.similarity.batch_neighbours` is exact and stays the default:
it multiplies every query with every row. The index trades a measured share of recall
for work: cell centres are trained on a bounded sample (``SAMPLE_ROWS`` rows and
``SAMPLE_BYTES`` at most), *every* row is assigned to its nearest centre, and a query
is compared exactly with all rows of the cells nearest to it; nothing is capped within
a cell. How many cells a query looks at (``probes``) is fitted: the smallest number that
finds at least ``target`` of the exact neighbours of a bounded sample of rows.

Rows are stored packed into blocks of bounded bytes per cell, spread by salt, so a
cell with a third of all rows is many blocks. These stay where they are: the queries
come to them in rounds of bounded bytes, as in the exact search, and a block meets the
queries that probe its cell. No vector is shuffled or copied per probed cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ranking import best_per_group, first_per_key
from vitrine.operators.similarity import _Asked, _Best, _Cands, _matrix, _unit_rows, _unpack, in_rounds, packer
from vitrine.session import checkpoint_path, ensure_checkpoint_dir

SAMPLE_ROWS = 1 << 16
SAMPLE_BYTES = 64 << 20
ASKED = 256  # sampled rows that fit the number of probes
STEPS = 10
TARGET = 0.95
SALTS = 16
PRODUCT_BYTES = 16 << 20  # of products held at once
MAX_CELLS = 4096


def _slices(n: int, row_bytes: int) -> Iterator[slice]:
    """Runs of rows whose products take ``PRODUCT_BYTES`` at most."""
    step = max(1, PRODUCT_BYTES // max(row_bytes, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each row's nearest centre; the products are held some rows at a time."""
    out = np.empty(len(rows), np.int64)
    for part in _slices(len(rows), 8 * len(centres)):
        out[part] = (rows[part] @ centres.T).argmax(axis=1)
    return out


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres by cosine k-means; the sample comes in hash order."""
    centres = sample[:cells].copy()
    for _ in range(STEPS):
        near = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        used = np.bincount(near, minlength=len(centres)) > 0
        centres[used] = _unit_rows(sums[used])
    return centres


def _fit_probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The fewest cells that hold ``target`` of the sample's exact neighbours."""
    cell = _nearest(sample, centres)
    first = max(len(sample) - ASKED, 0)
    places = []
    for part in _slices(len(sample) - first, 3 * 8 * len(sample)):
        asked = sample[first:][part]
        sims = asked @ sample.T
        sims[np.arange(len(asked)), first + part.start + np.arange(len(asked))] = -np.inf
        best = np.argsort(-sims, axis=1)[:, :min(k, len(sample) - 1)]
        order = np.argsort(-(asked @ centres.T), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        places.append(np.take_along_axis(rank, cell[best], axis=1).ravel())
    places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1 if len(places) else 1


def _assign(centres: np.ndarray, vec_col: str, probes: int):
    """Rows with their ``probes`` nearest cells, one row per cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row_bytes = 3 * 8 * len(centres) + probes * (batch.nbytes // batch.num_rows)
            for rows in _slices(batch.num_rows, row_bytes):
                part = batch.slice(rows.start, rows.stop - rows.start)
                near = np.argsort(-(_unit_rows(_matrix(pa.chunked_array([part.column(vec_col)]))) @ centres.T),
                                  axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(part.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)),
                                                  *(c.take(pa.array(at)) for c in part.columns)],
                                                 names=["cell", *batch.schema.names])
    return run


def _probed(asked: _Asked, centres: np.ndarray, probes: int) -> np.ndarray:
    """A bit for each query and cell: whether the cell is one of its ``probes`` nearest."""
    out = np.zeros((len(asked.mat), -(-len(centres) // 8)), np.uint8)
    for part in _slices(len(asked.mat), 3 * 8 * len(centres)):
        near = np.argsort(-(asked.mat[part] @ centres.T), axis=1, kind="stable")[:, :probes]
        chosen = np.zeros((len(near), len(centres)), bool)
        np.put_along_axis(chosen, near, True, axis=1)
        out[part] = np.packbits(chosen, axis=1)
    return out


def _meet(asked: list[bytes], best: _Best, centres: np.ndarray, probes: int):
    """The stored blocks against the queries of a round that probe their cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_Asked(_unpack(x)) for x in asked]
        bits = [_probed(t, centres, probes) for t in tables]
        held = [best.room(t) for t in tables]
        for batch in batches:
            for cell, c_rows in zip(batch.column("cell").to_pylist(), batch.column("rows")):
                cands = _Cands(_unpack(c_rows.as_py()), best.id_col, best.vec_col)
                for queries, probed, kept in zip(tables, bits, held):
                    here = np.flatnonzero(probed[:, cell // 8] >> (7 - cell % 8) & 1)
                    if not len(here):
                        continue
                    room = None if kept is None else kept[here]
                    yield from best(queries.some(here), cands, None, room)
                    if kept is not None:
                        kept[here] = room
    return run


def _blocks(df: DataFrame, salt: str) -> DataFrame:
    """(cell, rows): packed rows of one cell each."""
    spread = df.repartition("cell", F.pmod(F.xxhash64(salt), F.lit(SALTS))).sortWithinPartitions("cell")
    return spread.mapInArrow(packer("cell"), "cell int, rows binary")


@dataclass
class VectorIndex:
    """Stored blocks of a catalog with their cell centres."""

    blocks: DataFrame
    centres: np.ndarray
    probes: int
    id_col: str
    vec_col: str
    id_type: str

    @classmethod
    def build(cls, catalog: DataFrame, id_col: str = "appid", vec_col: str = "vec", cells: int | None = None,
              k: int = 10, target: float = TARGET, path: str | None = None) -> VectorIndex:
        """``catalog`` holds unit vectors of one length; rows without a vector take
        no part. The blocks are written to ``path`` (by default in the shared
        checkpoint folder)."""
        rows = catalog.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
        n, dim = rows.agg(F.count("*"), F.max(F.size(vec_col))).first()
        size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dim or 1, 1))))
        sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(size).select(vec_col).toArrow().column(vec_col)
        sample = _unit_rows(_matrix(sample)) if n else np.zeros((0, 0))
        centres = _centres(sample, cells or max(1, min(MAX_CELLS, int(np.sqrt(n)), len(sample)))) if n else sample
        probes = _fit_probes(sample, centres, k, target) if n else 1
        spark = catalog.sparkSession
        if path is None:
            ensure_checkpoint_dir(spark)
            path = checkpoint_path(spark, f"vector-index-{uuid.uuid4().hex[:12]}")
        kinds = dict(rows.dtypes)
        celled = rows.mapInArrow(_assign(centres, vec_col, 1), f"cell int, {id_col} {kinds[id_col]}, {vec_col} {kinds[vec_col]}")
        _blocks(celled, id_col).write.parquet(path)
        return cls(spark.read.parquet(path), centres, probes, id_col, vec_col, kinds[id_col])

    def search(self, queries: DataFrame, k: int = 10, keep_seed: bool = True, probes: int | None = None) -> DataFrame:
        """(qid, rank, id, similarity): the ``k`` best rows of the probed cells for
        each of ``queries`` (qid, qvec and optionally seed_id), as
        :func:`~vitrine.operators.similarity.batch_neighbours` without blend."""
        seed = F.col("seed_id") if "seed_id" in queries.columns else F.lit(None).cast(self.id_type)
        q = first_per_key(queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec"), seed.alias("seed_id")).where(
            F.col("qvec").isNotNull()), ["qid"], [F.xxhash64("qvec").asc(), F.col("seed_id").asc_nulls_last()])
        best = _Best(self.id_col, self.vec_col, keep_seed, k, None)
        probes = min(probes or self.probes, max(len(self.centres), 1))
        found = in_rounds(q, lambda asked: self.blocks.mapInArrow(
            _meet(asked, best, self.centres, probes),
            f"qid {dict(q.dtypes)['qid']}, {self.id_col} {self.id_type}, similarity double"))
        if found is None:
            found = q.sparkSession.createDataFrame([], f"qid {dict(q.dtypes)['qid']}, {self.id_col} {self.id_type}, similarity double")
        return best_per_group(found, ["qid"], [F.col("similarity").desc(), F.col(self.id_col).asc()], k).select(
            "qid", "rank", self.id_col, "similarity")


def recall(found: DataFrame, exact: DataFrame, id_col: str = "appid", qid: str = "qid") -> DataFrame:
    """One row (n_queries, n_exact, recall): the share of ``exact`` that was found."""
    both = exact.select(qid, id_col).join(found.select(qid, id_col).distinct().withColumn("hit", F.lit(1)), [qid, id_col], "left")
    return both.agg(F.count_distinct(qid).alias("n_queries"), F.count("*").alias("n_exact"),
                    (F.count("hit") / F.count("*")).alias("recall"))
