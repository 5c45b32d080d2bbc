"""Vector similarity operators over a serving catalog.

The catalog holds one unit-length ``array<double>`` per item (see
``catalog.serving_catalog``), so cosine similarity is a dot product.

Single query (one seed id or one query vector): the query vector enters the
plan as a *scalar subquery* (computed once, shipped to every task as a
constant). The plan is scan -> project -> filter -> partial top-k: no join,
no shuffle of catalog rows.

Many seeds: catalog and query vectors are packed into blocks of bounded bytes. The
catalog's blocks stay where they are; the queries are sent to them in rounds of
bounded bytes and multiplied (NumPy) block by block; each task gives out the rows among
a query's ``k`` best so far, and these are merged. Vectors are never shuffled per pair of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scoring import blend, log_count, min_max
from vitrine.functions.vectors import dot, l2_normalize
from vitrine.operators.filters import Filters, apply_filters
from vitrine.operators.ranking import best_per_group, first_per_key, top_k
from vitrine.session import checkpoint_path, ensure_checkpoint_dir

# --- fixed values: similarity of the seed row, output columns ---
SEED_SIMILARITY = -1.0
REC_COLUMNS = ["appid", "name", "short_description", "similarity", "positive_ratio",
               "review_count", "release_year", "release_date", "genres"]
SEARCH_COLUMNS = ["appid", "name", "short_description", "similarity", "score",
                  "positive_ratio", "review_count", "release_date", "genres"]
# --- end fixed values ---


def seed_vector(catalog: DataFrame, seed_id, id_col: str = "appid",
                vec_col: str = "vec") -> Column:
    """The seed's vector as a scalar-subquery column (null if unknown)."""
    one = catalog.where(F.col(id_col) == F.lit(seed_id)).select(
        F.min_by(F.col(vec_col), F.xxhash64(F.col(vec_col))))
    return one.scalar()


def seed_exists(catalog: DataFrame, seed_id, id_col: str = "appid") -> bool:
    """Point lookup (one pushed-down filter, stops at the first row)."""
    return not catalog.where(F.col(id_col) == F.lit(seed_id)).limit(1).isEmpty()


def _scored(catalog: DataFrame, qvec: Column, vec_col: str, normalize: bool = False) -> DataFrame:
    if normalize:
        # the query vector is a constant of the query: normalised once in a
        # one-row scalar subquery, not again for every catalog row
        qvec = (catalog.sparkSession.range(1).select(qvec.alias("__v"))
                .select(l2_normalize("__v")).scalar())
    # project the (subquery) vector first: subqueries may not sit inside lambdas
    df = catalog.withColumn("__q", qvec)
    return df.withColumn("similarity", dot(vec_col, "__q")).drop("__q")


def _blend_scores(df: DataFrame, ratio_col: str = "positive_ratio",
                  count_col: str = "review_count") -> DataFrame:
    """Add ``score``: min-max scaled similarity and log review count over the
    rows of ``df`` that have a similarity (the rows left after filtering),
    blended with the ratio. Rows without a similarity get a null score."""
    has_ratio, has_count = ratio_col in df.columns, count_col in df.columns
    scored = F.col("similarity").isNotNull()
    aggs = [F.min("similarity").alias("smin"), F.max("similarity").alias("smax")]
    if has_count:
        lc = F.when(scored, log_count(count_col))
        aggs += [F.min(lc).alias("cmin"), F.max(lc).alias("cmax")]
    # one scalar subquery returning a struct: one extra aggregation job
    stats = df.select(F.struct(*aggs).alias("s")).select("s").scalar()
    out = df.withColumn("__st", stats)
    sim_norm = min_max(F.col("similarity"), F.col("__st.smin"), F.col("__st.smax"))
    rc_norm = (min_max(log_count(count_col), F.col("__st.cmin"), F.col("__st.cmax"))
               if has_count else None)
    ratio = F.col(ratio_col) if has_ratio else None
    return out.withColumn("score", F.when(scored, blend(sim_norm, ratio, rc_norm))).drop("__st")


def _project(df: DataFrame, wanted: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in wanted if c in df.columns] + [c for c in extra if c in df.columns]
    return df.select(*cols)


def recommend_similar(catalog: DataFrame, seed_id, top_k_n: int = 10,
                      filters: Filters | None = None, use_blend: bool = False,
                      keep_seed: bool = True, strict: bool = False,
                      id_col: str = "appid", vec_col: str = "vec") -> DataFrame:
    """Items most similar to one seed item.

    Order of work: score all -> filter -> optional blend -> top-k. With
    ``keep_seed=True`` the seed stays as a row with similarity -1 (it shows
    when fewer than k other rows survive and lowers the blend's minimum).
    ``strict=True`` raises ``ValueError`` for an unknown seed (one point
    lookup); otherwise an unknown seed gives an empty result.
    """
    if strict and not seed_exists(catalog, seed_id, id_col):
        raise ValueError(f"no vector for {id_col} {seed_id}")
    q = seed_vector(catalog, seed_id, id_col, vec_col)
    is_seed = F.col(id_col) == F.lit(seed_id)
    df = catalog if keep_seed else catalog.where(~is_seed)
    df = apply_filters(df, filters)
    df = _scored(df, q, vec_col)
    if keep_seed:
        sim_ = F.col("similarity")
        df = df.withColumn("similarity", F.when(is_seed & sim_.isNotNull(), F.lit(SEED_SIMILARITY))
                           .otherwise(sim_))
    sort_col = "similarity"
    if use_blend:
        df = _blend_scores(df)
        sort_col = "score"
    # rows without a similarity (no vector, unknown seed) sort last and are
    # dropped from the k ranked rows: the same rows as dropping them first,
    # without a filter that Catalyst would push below the projection (and so
    # evaluate the dot product twice per row)
    ranked = top_k(df, [F.col(sort_col).desc_nulls_last(), F.col(id_col).asc()], top_k_n)
    ranked = ranked.where(F.col("similarity").isNotNull())
    return _project(ranked, ["rank"] + REC_COLUMNS, ["score"] if use_blend else [])


def query_vector_column(vec: Sequence[float] | Column) -> Column:
    """A literal query vector (unit-normalised here) or a vector column
    (normalised inside the plan by the caller)."""
    if isinstance(vec, Column):
        return vec
    arr = np.asarray(vec, dtype="float64").ravel()
    n = float(np.linalg.norm(arr))
    if n > 0:
        arr = arr / n
    return F.array(*[F.lit(float(x)) for x in arr])


def search_by_vector(catalog: DataFrame, vec: Sequence[float] | Column, top_k_n: int = 10,
                     filters: Filters | None = None, id_col: str = "appid",
                     vec_col: str = "vec", normalized: bool = False,
                     use_blend: bool = True) -> DataFrame:
    """Items nearest to a free query vector; blended and sorted by score
    (``use_blend=False``: plain cosine order, no ``score``, as the baseline
    recommender).

    ``vec`` may be a literal list (normalised here) or a column, e.g. the
    scalar subquery of :func:`stored_vector`; pass ``normalized=True`` when
    that column is already unit length."""
    q = query_vector_column(vec)
    df = apply_filters(catalog, filters)
    df = _scored(df, q, vec_col, normalize=isinstance(vec, Column) and not normalized)
    sort_col = "similarity"
    if use_blend:
        df = _blend_scores(df)
        sort_col = "score"
    ranked = top_k(df, [F.col(sort_col).desc_nulls_last(), F.col(id_col).asc()], top_k_n)
    ranked = ranked.where(F.col("similarity").isNotNull())
    cols = SEARCH_COLUMNS if use_blend else [c for c in SEARCH_COLUMNS if c != "score"]
    return _project(ranked, ["rank"] + cols)


def stored_vector(vectors: DataFrame, key, id_col: str, vec_col: str, normalize: bool = True) -> Column:
    """Scalar-subquery column holding the vector of one stored row,
    unit-normalised inside the subquery (once, not per scored row)."""
    one = vectors.where(F.col(id_col) == F.lit(key)).select(
        F.min_by(F.col(vec_col), F.xxhash64(F.col(vec_col))).alias("__v"))
    if normalize:
        one = one.select(l2_normalize("__v"))
    return one.scalar()


# ------------------------------------------------------------------ many queries

# Bytes of vectors in one packed block, and of similarities held at once.
BLOCK_BYTES = 4 << 20
SIMS_BYTES = 4 << 20
# Bytes of query vectors sent to the catalog's blocks at once.
ROUND_BYTES = 16 << 20
# Bytes of the best scores that a task keeps for a block of queries; rows given out at once.
HELD_BYTES = 8 << 20
OUT_ROWS = 1 << 17


def _unit_rows(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.where(n > 0, mat / np.where(n > 0, n, 1.0), 0.0)


def packer(id_col: str | None = None):
    """Rows (Arrow batches) to blocks of about ``BLOCK_BYTES`` (``rows``: an Arrow
    stream); with ``id_col`` a block holds rows of one value of it (rows come in
    runs)."""
    limit = BLOCK_BYTES

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[object, pa.RecordBatch]]:
        if id_col is None:
            yield None, batch
            return
        values = batch.column(id_col).to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield values[lo].item(), batch.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, value = 0, None

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for part in held:
                    out.write_batch(part)
            block = {"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
            return pa.RecordBatch.from_pydict(block if id_col is None else {id_col: pa.array([value], held[0].schema.field(id_col).type), **block})
        for whole in batches:
            per_row = max(1.0, whole.nbytes / max(whole.num_rows, 1))
            for here, batch in runs(whole):
                if held and here != value:
                    yield flush()
                    held, size = [], 0
                value = here
                step = max(1, int(limit // per_row))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    n = int(per_row * part.num_rows)
                    if held and size + n > limit:
                        yield flush()
                        held, size = [], 0
                    held.append(part)
                    size += n
        if held:
            yield flush()
    return run


def _packed(df: DataFrame) -> DataFrame:
    """Rows packed to blocks (``id``, ``rows``). Each task packs what it has: no
    shuffle, and copies of a row never make a block larger than the others."""
    return df.mapInArrow(packer(), "rows binary").withColumn("id", F.monotonically_increasing_id()).checkpoint()


def _query_rounds(q: DataFrame) -> Iterator[list[bytes]]:
    """The packed queries, some blocks of ``ROUND_BYTES`` at most (one at least) at
    a time; the driver holds one round."""
    blocks = _packed(q)
    sizes = blocks.select("id", F.octet_length("rows").alias("n")).orderBy("id").collect()  # a number per block
    held, size = [], 0
    rounds: list[list[int]] = []
    for r in sizes:
        if held and size + r.n > ROUND_BYTES:
            rounds.append(held)
            held, size = [], 0
        held.append(r.id)
        size += r.n
    if held:
        rounds.append(held)
    for ids in rounds:
        yield [bytes(r.rows) for r in blocks.where(F.col("id").isin(ids)).orderBy("id").collect()]


def _unpack(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(flat), -1)


class _Asked:
    """A block of queries: unit vectors and seeds."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.mat = _unit_rows(_matrix(table.column("qvec")))
        self.seeds = table.column("seed_id").to_pylist()
        self.odd = ~np.isfinite(self.mat).all(axis=1)  # nothing is similar to these

    def some(self, rows: np.ndarray) -> _Asked:
        """The queries of some rows (their vectors are no longer in the table)."""
        out = _Asked.__new__(_Asked)
        out.table = self.table.select(["qid"]).take(pa.array(rows))
        out.mat, out.odd, out.seeds = self.mat[rows], self.odd[rows], [self.seeds[i] for i in rows]
        return out


class _Cands:
    """A block of candidates; rows with a component that is no number are similar to nothing."""

    def __init__(self, table: pa.Table, id_col: str, vec_col: str):
        self.table = table
        mat = _matrix(table.column(vec_col))
        self.odd = ~np.isfinite(mat).all(axis=1)
        self.mat = np.where(self.odd[:, None], np.nan, mat) if self.odd.any() else mat
        self.flat = np.where(self.odd[:, None], 0.0, mat) if self.odd.any() else mat
        self.norm = float(np.sqrt((self.flat * self.flat).sum(axis=1).max(initial=0.0)))
        self.places: dict = {}
        for i, key in enumerate(table.column(id_col).to_pylist()):
            self.places.setdefault(key, []).append(i)

    def seeds_of(self, asked: _Asked) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the queries' own rows, by query."""
        met = [(c, i) for c, s in enumerate(asked.seeds) if s is not None for i in self.places.get(s, ())]
        pairs = np.array(met, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _exact(asked: _Asked, cands: _Cands, q: np.ndarray, c: np.ndarray, own: np.ndarray, keep_seed: bool) -> np.ndarray:
    """Similarities of pairs, in runs of bounded size; ``own``: codes of seed pairs."""
    out = np.empty(len(q))
    step = max(1, SIMS_BYTES // (16 * max(cands.mat.shape[1], 1)))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        out[part] = np.einsum("ij,ij->i", asked.mat[q[part]], cands.mat[c[part]])
    if len(own):
        out[np.isin(q * len(cands.mat) + c, own)] = SEED_SIMILARITY if keep_seed else -np.inf
    return out


def _float_tiles(asked: _Asked, cands: _Cands, scale: np.ndarray | None, fixed: np.ndarray | None,
                 keep_seed: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """``scale`` x similarity + ``fixed`` (queries x candidates) in single precision,
    some queries at a time, with a bound of each query's error and the seed pairs
    (already set): what the few pairs that matter are found by."""
    left, right = asked.mat, cands.flat
    most = np.full(len(left), cands.norm)
    if scale is not None:
        left = np.hstack([left * scale[:, None], np.ones((len(left), 1))])
        right = np.hstack([right, fixed[:, None]])
        most = scale * cands.norm + np.abs(fixed).max(initial=0.0)
    with np.errstate(over="ignore", invalid="ignore"):
        left, right = np.where(asked.odd[:, None], 0, left).astype(np.float32), right.astype(np.float32).T
        error = (right.shape[0] + 4) * 2.0 ** -22 * np.maximum(most, 1e-30)
    error[~np.isfinite(error) | (error > 1e30) | asked.odd] = np.inf
    seed_q, seed_c = cands.seeds_of(asked)
    odd = np.flatnonzero(cands.odd)
    step = max(1, SIMS_BYTES // (4 * right.shape[1]))
    for at in range(0, len(left), step):
        cols = slice(at, min(at + step, len(left)))
        tile = left[cols] @ right
        lo, hi = np.searchsorted(seed_q, (cols.start, cols.stop))
        q, c = seed_q[lo:hi] - at, seed_c[lo:hi]
        if len(q):
            tile[q, c] = -np.inf if not keep_seed else SEED_SIMILARITY if scale is None else (
                scale[q + at] * SEED_SIMILARITY + fixed[c])
        own = (seed_q[lo:hi] * right.shape[1] + seed_c[lo:hi], c)
        if len(odd):
            tile[:, odd] = -np.inf
            if len(q) and keep_seed:  # a seed's own row counts whatever its vector holds
                again = np.isin(c, odd)
                tile[q[again], c[again]] = SEED_SIMILARITY if scale is None else scale[q[again] + at] * SEED_SIMILARITY + fixed[c[again]]
        yield cols, tile, error[cols], own


def _minmax_cells(asked: list[bytes], id_col: str, vec_col: str, keep_seed: bool):
    """Each query's least and largest similarity to the rows of a task."""
    def update(queries: _Asked, cands: _Cands, low: np.ndarray, high: np.ndarray) -> None:
        for cols, tile, error, (own, _) in _float_tiles(queries, cands, None, None, keep_seed):
            for sign, best, pick in ((1.0, high, np.fmax), (-1.0, low, np.fmin)):
                if sign < 0:
                    tile = np.where(tile == -np.inf, -np.inf, -tile)  # rows that do not count stay last
                top = tile.max(axis=1).astype("float64")
                with np.errstate(invalid="ignore"):
                    need = np.flatnonzero((top > -np.inf) & ~(top + error < sign * best[cols]))
                    part = tile[need] >= np.where(np.isfinite(error[need]), top[need] - 2 * error[need], -np.inf)[:, None]
                q, c = np.nonzero(part)
                q = need[q] + cols.start
                exact = _exact(queries, cands, q, c, own, keep_seed)
                ok = np.isfinite(exact)
                pick.at(best, q[ok], exact[ok])

    def run(batches):
        tables = [_Asked(_unpack(x)) for x in asked]
        low = [np.full(len(t.mat), np.inf) for t in tables]
        high = [np.full(len(t.mat), -np.inf) for t in tables]
        for batch in batches:
            for c_rows in batch.column("rows"):
                cands = _Cands(_unpack(c_rows.as_py()), id_col, vec_col)
                for b, queries in enumerate(tables):
                    update(queries, cands, low[b], high[b])
        for b in range(len(tables)):
            ok = np.flatnonzero(np.isfinite(low[b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ok), b)), pa.array(ok), pa.array(low[b][ok]), pa.array(high[b][ok])],
                ["b", "q", "smin", "smax"])
    return run


class _Best:
    """The k best rows of a block of candidates for a block of queries.

    Products in single precision rule out the pairs that cannot be among the k best
    (their error is bounded); the pairs left are scored in double precision. ``held``
    are each query's k best scores in the blocks before: rows below them are left out."""

    def __init__(self, id_col: str, vec_col: str, keep_seed: bool, k: int, reviews_range: tuple[float, float] | None):
        self.id_col, self.vec_col, self.keep_seed, self.k, self.range = id_col, vec_col, keep_seed, k, reviews_range

    def room(self, queries: _Asked) -> np.ndarray | None:
        """Held scores of a block of queries; none if these would take much memory."""
        return np.full((len(queries.mat), self.k), -np.inf) if 8 * len(queries.mat) * self.k <= HELD_BYTES else None

    def _least(self, tile: np.ndarray) -> np.ndarray:
        """A score that k rows of each query reach: the k-th of the maxima of groups of rows."""
        groups = min(tile.shape[1], max(64, 4 * self.k))
        if groups < self.k:
            return np.full(len(tile), -np.inf)
        whole = tile.shape[1] // groups
        tops = tile[:, :groups * whole].reshape(len(tile), whole, groups).max(axis=1)
        return np.partition(tops, groups - self.k, axis=1)[:, groups - self.k].astype("float64")

    def __call__(self, queries: _Asked, cands: _Cands, extremes: np.ndarray | None,
                 held: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        from vitrine.functions.scoring import (BLEND_RATIO_DEFAULT, RATIO_WEIGHT, REVIEWS_WEIGHT, SCALE_EPS,
                                               SIM_WEIGHT)

        def number(table: pa.Table, name: str) -> np.ndarray:
            return table.column(name).to_numpy().astype("float64")
        id_col, k = self.id_col, self.k
        if not len(cands.mat) or not len(queries.mat):
            return
        order = np.unique(cands.table.column(id_col).to_numpy(), return_inverse=True)[1]  # ties go by id
        scale = fixed = None
        base = np.zeros(len(queries.mat))
        if self.range is not None:
            ratio = number(cands.table, "__ratio")
            ratio = np.where(np.isnan(ratio), BLEND_RATIO_DEFAULT, ratio)
            low, high = self.range
            reviews = (number(cands.table, "__lc") - low) / (high - low + SCALE_EPS)
            fixed = RATIO_WEIGHT * ratio + REVIEWS_WEIGHT * reviews
            smin, smax = extremes
            scale = SIM_WEIGHT / (smax - smin + SCALE_EPS)
            base = scale * smin  # a score is the tile's value less this
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            q, c, sims, key = (np.concatenate(x) for x in zip(*found))
            out = {"qid": queries.table.column("qid").take(pa.array(q)).combine_chunks(),
                   id_col: cands.table.column(id_col).take(pa.array(c)).combine_chunks(), "similarity": pa.array(sims)}
            if self.range is not None:
                out["score"] = pa.array(key)
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))
        for cols, tile, error, (own, _) in _float_tiles(queries, cands, scale, fixed, self.keep_seed):
            past = np.full(len(tile), -np.inf) if held is None else held[cols].min(axis=1)
            start = past + base[cols]
            if not np.isfinite(past).all():
                start = np.maximum(start, self._least(tile))
            with np.errstate(invalid="ignore"):
                least = np.where(np.isfinite(error), start - 2 * error, -np.inf)
            # rounded down, so that the comparison in single precision loses nothing
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            at = np.flatnonzero((tile >= least[:, None]).ravel())
            q, c = at // tile.shape[1], at % tile.shape[1]
            sims = _exact(queries, cands, q + cols.start, c, own, self.keep_seed)
            key = sims
            if self.range is not None:
                key = SIM_WEIGHT * ((sims - smin[q + cols.start]) / (smax[q + cols.start] - smin[q + cols.start] + SCALE_EPS)) + fixed[c]
            ok = np.isfinite(sims) & np.isfinite(key) & (key >= past[q])
            q, c, sims, key = q[ok], c[ok], sims[ok], key[ok]
            by = np.lexsort((order[c], -key, q))
            q, c, sims, key = q[by], c[by], sims[by], key[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            first = place < k
            q, c, sims, key, place = q[first], c[first], sims[first], key[first], place[first]
            if not len(q):
                continue
            if held is not None:
                new = np.full((len(tile), k), -np.inf)
                new[q, place] = key
                held[cols] = np.partition(np.hstack([held[cols], new]), k, axis=1)[:, k:]
            found.append((q + cols.start, c, sims, key))
            size += len(q)
            if size >= OUT_ROWS:
                yield flush()
                found, size = [], 0
        if found:
            yield flush()


def _topk_cells(asked: list[bytes], best: _Best, extremes: list[np.ndarray] | None):
    def run(batches):
        tables = [_Asked(_unpack(x)) for x in asked]
        held = [best.room(t) for t in tables]
        for batch in batches:
            for c_rows in batch.column("rows"):
                cands = _Cands(_unpack(c_rows.as_py()), best.id_col, best.vec_col)
                for b, queries in enumerate(tables):
                    yield from best(queries, cands, None if extremes is None else extremes[b], held[b])
    return run


def _extremes(found: DataFrame, asked: list[bytes]) -> list[np.ndarray]:
    """Least and largest similarity of every query of a round (two numbers each)."""
    table = found.groupBy("b", "q").agg(F.min("smin").alias("smin"), F.max("smax").alias("smax")).toArrow()
    b, q, low, high = (table.column(c).to_numpy() for c in ("b", "q", "smin", "smax"))
    out = []
    for k, raw in enumerate(asked):
        both = np.zeros((2, _unpack(raw).num_rows))
        both[:, q[b == k]] = low[b == k], high[b == k]
        out.append(both)
    return out


def in_rounds(q: DataFrame, one_round: Callable[[list[bytes]], DataFrame]) -> DataFrame | None:
    """``one_round`` of all packed queries, a round at a time; with more than one round
    each is written when its queries are at hand. None without queries."""
    spark, partial, path = q.sparkSession, None, None
    for asked in _query_rounds(q):
        if partial is not None:
            if path is None:
                ensure_checkpoint_dir(spark)
                path = checkpoint_path(spark, f"rounds-{uuid.uuid4().hex[:12]}")
                partial.write.parquet(path)
            one_round(asked).write.mode("append").parquet(path)
        else:
            partial = one_round(asked)
    return partial if path is None else spark.read.schema(partial.schema).parquet(path)


def batch_neighbours(catalog: DataFrame, queries: DataFrame, top_k_n: int = 10,
                     filters: Filters | None = None, use_blend: bool = False,
                     keep_seed: bool = True, id_col: str = "appid", vec_col: str = "vec") -> DataFrame:
    """Exact top-k neighbours for many query vectors.

    ``queries``: ``qid``, ``qvec`` (any length-matching vector, normalised
    here) and optionally ``seed_id`` (the catalog row that gets similarity
    -1, or is dropped with ``keep_seed=False``). Same semantics per query as
    :func:`recommend_similar` / :func:`search_by_vector`: filters first, then
    the blend scaled over each query's filtered rows; ties go to the smaller id.

    Catalog and queries are packed into blocks of bounded bytes. The catalog is
    packed where it is read and never shuffled. The queries go to its blocks in
    rounds of ``ROUND_BYTES`` at most (so what is broadcast has a proven bound); in a
    round one distributed job multiplies them and keeps the rows that are among a
    query's ``k`` best in the blocks a task has read, ids and scores only, which are merged. With the blend a job of the same
    form gathers each query's minimum and maximum first. A small query table is one
    round; further rounds are written as they end.
    """
    seed = F.col("seed_id") if "seed_id" in queries.columns else F.lit(None).cast(catalog.schema[id_col].dataType)
    # one row per query id; conflicting vectors under one id keep the smallest hash
    q = first_per_key(queries.select("qid", "qvec", seed.alias("seed_id")).where(F.col("qvec").isNotNull()), ["qid"],
                      [F.xxhash64("qvec").asc(), F.col("seed_id").asc_nulls_last()])
    cands = apply_filters(catalog, filters).where(F.col(vec_col).isNotNull())
    if use_blend:
        ratio = F.col("positive_ratio").cast("double") if "positive_ratio" in cands.columns else F.lit(None).cast("double")
        counts = log_count("review_count") if "review_count" in cands.columns else F.lit(0.0)
        cands = cands.select(id_col, vec_col, ratio.alias("__ratio"), counts.alias("__lc"))
    else:
        cands = cands.select(id_col, vec_col)
    blocks = _packed(cands).select("rows")
    id_type = catalog.schema[id_col].dataType.simpleString()
    qid_type = q.schema["qid"].dataType.simpleString()
    out_cols = ["qid", "rank", id_col, "similarity"] + (["score"] if use_blend else [])
    schema = f"qid {qid_type}, {id_col} {id_type}, similarity double" + (", score double" if use_blend else "")
    reviews_range = None
    if use_blend:
        low, high = cands.agg(F.min("__lc"), F.max("__lc")).first()
        if "review_count" not in catalog.columns:  # the reviews term is then the constant 0.5
            low, high = -0.5, 0.5
        reviews_range = (float(low or 0.0), float(high or 0.0))
    best = _Best(id_col, vec_col, keep_seed, top_k_n, reviews_range)

    def one_round(asked: list[bytes]) -> DataFrame:
        extremes = None
        if use_blend:
            extremes = _extremes(blocks.mapInArrow(_minmax_cells(asked, id_col, vec_col, keep_seed),
                                                   "b bigint, q bigint, smin double, smax double"), asked)
        return blocks.mapInArrow(_topk_cells(asked, best, extremes), schema)
    partial = in_rounds(q, one_round)
    if partial is None:
        partial = catalog.sparkSession.createDataFrame([], schema)
    sort = F.col("score") if use_blend else F.col("similarity")
    # a query has some rows of each task at most: no group is large enough to be salted
    return best_per_group(partial, ["qid"], [sort.desc(), F.col(id_col).asc()], top_k_n).select(*out_cols)


def recommend_batch(catalog: DataFrame, seeds: DataFrame, top_k_n: int = 10,
                    filters: Filters | None = None, keep_seed: bool = True, use_blend: bool = False,
                    id_col: str = "appid", vec_col: str = "vec", seed_col: str = "seed_id") -> DataFrame:
    """Top-k similar items for every seed id in ``seeds`` (exact), the batch
    form of :func:`recommend_similar`. Unknown seeds give no rows."""
    # a semi-join never multiplies rows: catalog copies of a seed collapse
    # to one query in batch_neighbours (one row per id per task, then one)
    seed_ids = seeds.select(F.col(seed_col).alias("qid")).distinct()
    seed_vecs = (catalog.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("qvec"))
                 .join(seed_ids, "qid", "left_semi")
                 .withColumn("seed_id", F.col("qid")))
    out = batch_neighbours(catalog, seed_vecs, top_k_n, filters, use_blend, keep_seed, id_col, vec_col)
    return out.withColumnRenamed("qid", "seed_id")


def search_batch(catalog: DataFrame, queries: DataFrame, top_k_n: int = 10,
                 filters: Filters | None = None, id_col: str = "appid", vec_col: str = "vec") -> DataFrame:
    """The batch form of :func:`search_by_vector` for ``(qid, qvec)`` rows
    (always blended)."""
    return batch_neighbours(catalog, queries.select("qid", "qvec"), top_k_n, filters, True, True, id_col, vec_col)


# ------------------------------------------------------------------ graph

GRAPH_BLOCK = 256


def similarity_graph(catalog: DataFrame, recs: DataFrame, seed_id, seed_name: Column | None = None,
                     threshold: float = 0.7, keep_seed: bool = True,
                     id_col: str = "appid", vec_col: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a one-hop similarity graph around a seed.

    ``recs`` is a top-k result (``rank``, ``appid``, ``name``, ``similarity``).
    Edges: seed -> each result (its similarity, no threshold) and result ->
    result pairs (i < j in rank order) with cosine >= ``threshold``. The k result
    rows are written once with their vectors; pairs are joined by blocks of
    ranks, so no row holds more than one vector pair whatever ``k`` is.
    """
    if not keep_seed:
        recs = recs.where(F.col(id_col) != F.lit(seed_id))
    recs = recs.checkpoint()
    # one vector per result id: copies of an item in the catalog never multiply the k result rows
    vecs = first_per_key(catalog.select(id_col, vec_col).join(recs.select(id_col), id_col, "left_semi"),
                         [id_col], [F.xxhash64(F.col(vec_col)).asc()])
    with_vec = recs.select("rank", id_col).join(vecs, id_col).withColumn(
        "__b", F.floor((F.col("rank") - 1) / GRAPH_BLOCK).cast("int")).checkpoint()
    center_label = seed_name if seed_name is not None else \
        catalog.where(F.col(id_col) == F.lit(seed_id)).select(F.min("name")).scalar()
    center = catalog.sparkSession.range(1).select(
        F.lit(seed_id).cast("string").alias("id"), center_label.alias("label"),
        F.lit(0).alias("group"), F.lit(0).alias("rank"))
    others = recs.select(F.col(id_col).cast("string").alias("id"), F.col("name").alias("label"),
                         F.lit(1).alias("group"), F.col("rank"))
    nodes = center.unionByName(others)
    seed_edges = recs.select(F.lit(seed_id).cast("string").alias("source"),
                             F.col(id_col).cast("string").alias("target"),
                             F.col("similarity").alias("value"))
    last = with_vec.agg(F.max("__b")).first()[0] or 0
    earlier = with_vec.select(F.col("rank").alias("__r"), F.col(id_col).alias("__i"), F.col(vec_col).alias("__v"),
                              F.explode(F.sequence(F.col("__b"), F.lit(last))).alias("__b"))
    pairs = earlier.join(with_vec, "__b").where(F.col("__r") < F.col("rank")).withColumn("value", dot("__v", vec_col))
    pair_edges = pairs.where(F.col("value") >= F.lit(threshold)).select(
        F.col("__i").cast("string").alias("source"), F.col(id_col).cast("string").alias("target"), "value")
    return nodes, seed_edges.unionByName(pair_edges)
