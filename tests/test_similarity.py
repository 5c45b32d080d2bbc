"""Similarity operators on small hand-made catalogs, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.vectors import l2_normalize
from vitrine.operators import similarity
from vitrine.operators.filters import Filters
from vitrine.operators.similarity import (recommend_batch, recommend_similar, search_by_vector,
                                          similarity_graph)

SCHEMA = ("appid bigint, name string, short_description string, release_year int, "
          "positive_ratio double, review_count bigint, genres array<string>, emb array<double>")


def catalog(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("vec", l2_normalize("emb")).drop("emb")


def rows_basic():
    return [
        (1, "a", "d", 2000, 0.9, 100, ["x"], [1.0, 0.0, 0.0]),
        (2, "b", None, 2001, None, None, [], [0.9, 0.1, 0.0]),
        (3, "c", "d", 2002, 0.1, 5, ["y"], [0.0, 1.0, 0.0]),
        (4, "d", "d", None, 0.5, 0, None, [0.0, 0.0, 0.0]),       # zero vector
        (5, "e", "d", 2003, 1.0, 1000, ["x"], [0.9, 0.1, 0.0]),   # ties with 2
        (6, "f", "d", 2004, 0.3, 20, ["z"], [-1.0, 0.0, 0.0]),
    ]


def test_zero_vector_normalises_to_zero(spark):
    c = catalog(spark, rows_basic())
    v = c.where("appid = 4").first()["vec"]
    assert v == [0.0, 0.0, 0.0]


def test_similarity_order_and_ties(spark):
    c = catalog(spark, rows_basic())
    r = recommend_similar(c, 1, 10).collect()
    # 2 and 5 tie, 3 and the zero vector 4 tie at 0 -> key order; seed -1 kept
    assert [x.appid for x in r] == [2, 5, 3, 4, 1, 6]
    assert r[4].similarity == -1.0


def test_seed_removed(spark):
    c = catalog(spark, rows_basic())
    r = recommend_similar(c, 1, 10, keep_seed=False).collect()
    assert 1 not in [x.appid for x in r]


def test_seed_only_survivor(spark):
    c = catalog(spark, rows_basic())
    r = recommend_similar(c, 1, 10, Filters(genres=("x",)), keep_seed=True).collect()
    assert [x.appid for x in r] == [5, 1]


def test_unknown_seed(spark):
    c = catalog(spark, rows_basic())
    assert recommend_similar(c, 99, 10).count() == 0
    with pytest.raises(ValueError):
        recommend_similar(c, 99, 10, strict=True)


def test_blend_matches_numpy(spark):
    rows = rows_basic()
    c = catalog(spark, rows)
    got = {r.appid: r.score for r in recommend_similar(c, 1, 10, use_blend=True).collect()}
    vec = {r[0]: np.array(r[7], dtype=float) for r in rows}
    unit = {k: (v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v) for k, v in vec.items()}
    sims = {k: (-1.0 if k == 1 else float(unit[k] @ unit[1])) for k in vec}
    ratio = {r[0]: (0.5 if r[4] is None else r[4]) for r in rows}
    lc = {r[0]: np.log1p(r[5] or 0) for r in rows}
    smin, smax = min(sims.values()), max(sims.values())
    cmin, cmax = min(lc.values()), max(lc.values())
    for k in vec:
        want = 0.6 * (sims[k] - smin) / (smax - smin + 1e-8) + 0.25 * ratio[k] + 0.15 * (lc[k] - cmin) / (cmax - cmin + 1e-8)
        assert got[k] == pytest.approx(want, abs=1e-12)


def test_search_by_vector_literal(spark):
    c = catalog(spark, rows_basic())
    r = search_by_vector(c, [0.0, 2.0, 0.0], 2).collect()
    assert r[0].appid == 3 and r[0].similarity == pytest.approx(1.0)
    assert "release_year" not in r[0].asDict()


def test_batch_matches_bruteforce(spark):
    rng = np.random.default_rng(5)
    n, d = 60, 8
    mat = rng.normal(size=(n, d))
    rows = [(i, f"n{i}", "d", 2000, 0.5, 1, [], mat[i].tolist()) for i in range(n)]
    c = catalog(spark, rows)
    seeds = spark.range(0, n, 3).select(F.col("id").alias("seed_id"))
    got = recommend_batch(c, seeds, 4)
    got = {(r.seed_id, r.rank): r.appid for r in got.collect()}
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    for s in range(0, n, 3):
        sims = unit @ unit[s]
        sims[s] = -1.0
        order = sorted(range(n), key=lambda j: (-sims[j], j))[:4]
        assert [got[(s, k + 1)] for k in range(4)] == order


def test_graph_edges(spark):
    c = catalog(spark, rows_basic())
    recs = recommend_similar(c, 1, 3)
    nodes, edges = similarity_graph(c, recs, 1, F.lit("a"), threshold=0.9)
    assert nodes.count() == 4
    e = {(r.source, r.target) for r in edges.collect()}
    assert ("1", "2") in e and ("2", "5") in e     # 2 and 5 are identical vectors
    assert ("2", "4") not in e


def random_catalog(spark, n=50, d=6, seed=3):
    rng = np.random.default_rng(seed)
    mat = rng.normal(size=(n, d))
    rows = []
    for i in range(n):
        ratio = None if i % 7 == 0 else float(rng.uniform())
        count = None if i % 5 == 0 else int(rng.integers(0, 500))
        rows.append((i, f"n{i}", "d", 1990 + int(rng.integers(0, 20)), ratio, count, ["x"], mat[i].tolist()))
    return catalog(spark, rows)


@pytest.mark.parametrize("keep_seed", [True, False])
def test_batch_blend_equals_single(spark, keep_seed):
    c = random_catalog(spark)
    f = Filters(min_year=1995)
    seeds = spark.createDataFrame([(s,) for s in (0, 3, 11, 40, 999)], "seed_id bigint")
    got = recommend_batch(c, seeds, 5, f, keep_seed=keep_seed, use_blend=True)
    got = {(r.seed_id, r.rank): (r.appid, r.score) for r in got.collect()}
    assert not [k for k in got if k[0] == 999]
    for s in (0, 3, 11, 40):
        single = recommend_similar(c, s, 5, f, use_blend=True, keep_seed=keep_seed).collect()
        for r in single:
            appid, score = got[(s, r["rank"])]
            assert appid == r.appid and score == pytest.approx(r.score, abs=1e-9)


def test_search_batch_equals_single(spark):
    from vitrine.operators.similarity import search_batch
    c = random_catalog(spark)
    qs = [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.2, -1.0, 0.5, 0.0, 3.0, 0.0]]
    q = spark.createDataFrame([(i, v) for i, v in enumerate(qs)], "qid int, qvec array<double>")
    got = {(r.qid, r.rank): r.appid for r in search_batch(c, q, 4, Filters(max_year=2005)).collect()}
    for i, v in enumerate(qs):
        single = search_by_vector(c, v, 4, Filters(max_year=2005)).collect()
        assert [got[(i, r["rank"])] for r in single] == [r.appid for r in single]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_dot_product_per_pass(spark):
    """The similarity is computed once per scan: no null filter that
    Catalyst copies below the projection (one pass plain, two with the
    blend, whose min/max subquery scans again)."""
    c = catalog(spark, rows_basic())
    plain = recommend_similar(c, 1, 3, Filters(min_year=2000))
    blended = recommend_similar(c, 1, 3, Filters(min_year=2000), use_blend=True)
    assert _plan(plain).count("zip_with") == 1
    assert _plan(blended).count("zip_with") == 2


def test_l2_normalize_linear_in_dimension(spark):
    """The norm is accumulated once per row (a norm inside the element
    lambda costs dim^2 per row: minutes here instead of seconds)."""
    import time
    d = 4096
    df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(d)),
                                             lambda i: (i % 7 - 3).cast("float")).alias("v"))
    t = time.perf_counter()
    s = df.select(F.aggregate(l2_normalize("v"), F.lit(0.0), lambda a, x: a + x * x).alias("n2")) \
        .agg(F.min("n2"), F.max("n2")).first()
    assert time.perf_counter() - t < 30
    assert s[0] == pytest.approx(1.0) and s[1] == pytest.approx(1.0)


def test_search_unblended_is_cosine_order(spark):
    c = catalog(spark, rows_basic())
    got = search_by_vector(c, [2.0, 0.2, 0.0], 6, use_blend=False).collect()
    assert "score" not in got[0].asDict()
    sims = [r.similarity for r in got]
    assert sims == sorted(sims, reverse=True)
    # ties (2 and 5 hold the same vector) by key
    assert [r.appid for r in got][:3] == [2, 5, 1]


def test_batch_query_copies_collapse(spark):
    """A query id held by many rows (copies) is one query; blocking ends."""
    from vitrine.operators.similarity import search_batch
    c = random_catalog(spark)
    v = [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]
    q = spark.createDataFrame([(1, v)] * 40 + [(2, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])],
                              "qid int, qvec array<double>")
    got = search_batch(c, q, 3)
    rows = got.collect()
    assert sorted((r.qid, r["rank"]) for r in rows) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    single = search_by_vector(c, v, 3).collect()
    assert [r.appid for r in sorted((r for r in rows if r.qid == 1), key=lambda r: r["rank"])] == \
        [r.appid for r in single]


def test_graph_with_catalog_copies(spark):
    """Copies of a result item in the catalog do not multiply its edges."""
    rows = rows_basic()
    c = catalog(spark, rows + [rows[1]] * 30)        # item 2 held by 31 rows
    recs = recommend_similar(c, 1, 3)
    assert [r.appid for r in recs.collect()] == [2, 2, 2]
    nodes, edges = similarity_graph(c, recs, 1, F.lit("a"), threshold=0.9)
    assert nodes.count() == 4
    e = sorted((r.source, r.target, round(r.value, 6)) for r in edges.collect())
    # three seed edges and the three rank pairs of the result rows, as the
    # reference's per-row loop gives; not one per catalog copy
    assert len(e) == 6
    assert [x for x in e if x[0] == "2"] == [("2", "2", 1.0)] * 3


def test_batch_seed_copies(spark):
    """A seed held by many catalog rows is one query, as in the single form."""
    rows = rows_basic()
    c = catalog(spark, rows + [rows[0]] * 20)         # seed 1 held by 21 rows
    got = recommend_batch(c, spark.createDataFrame([(1,), (1,)], "seed_id bigint"), 3)
    single = recommend_similar(c, 1, 3).collect()
    assert [(r.seed_id, r["rank"], r.appid) for r in got.orderBy("rank").collect()] == \
        [(1, r["rank"], r.appid) for r in single]


def test_graph_request_equals_graph_for(spark):
    from vitrine.operators.filters import parse_filters
    from vitrine.plans.recommend import graph_for, graph_request
    c = catalog(spark, rows_basic()).withColumn("type", F.lit("game")).withColumn("is_free", F.lit("false"))
    params = {"name": " A ", "min_year": "2001", "is_multi": "true"}
    nodes, edges = graph_request(c, params, 3, threshold=0.5)
    f, blend = parse_filters(params, "legacy")
    n2, e2 = graph_for(c, 1, 3, f, blend, threshold=0.5)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(nodes) == key(n2) and key(edges) == key(e2)
    assert key(nodes)[0][:2] == ("1", "a")
    with pytest.raises(ValueError):
        graph_request(c, {"name": "  "})


def make_axis_encoder():
    def enc(texts):
        return [[1.0 if "x" in t else 0.0, 1.0 if "y" in t else 0.0, 0.1] for t in texts]
    return enc


def make_shout():
    def fn(t):
        return None if t == "keep me" else "Output: " + t.replace("q", "y")
    return fn


def test_prompt_recommend(spark):
    from vitrine.plans.recommend import prompt_recommend
    c = catalog(spark, rows_basic())
    qs = spark.createDataFrame([(1, "3"), (2, "A"), (3, "some x"), (4, "q q"), (5, " "), (6, "keep me")],
                               "qid int, text string")
    got = prompt_recommend(c, qs, make_axis_encoder, make_shout, top_k_n=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.qid, []).append(r)
    assert {r.mode for r in by[1]} == {"appid"} and by[1][0].center_appid == 3
    assert sorted((r["rank"], r.appid) for r in by[1]) == \
        [(r["rank"], r.appid) for r in recommend_similar(c, 3, 2).collect()]
    assert {r.mode for r in by[2]} == {"name"} and by[2][0].center_appid == 1
    # semantic: rewritten "q q" -> "y y" points along y; "some x" along x
    assert [r.appid for r in sorted(by[3], key=lambda r: r["rank"])] == \
        [r.appid for r in search_by_vector(c, [1.0, 0.0, 0.1], 2).collect()]
    assert [r.appid for r in sorted(by[4], key=lambda r: r["rank"])] == \
        [r.appid for r in search_by_vector(c, [0.0, 1.0, 0.1], 2).collect()]
    assert [r.appid for r in sorted(by[6], key=lambda r: r["rank"])] == \
        [r.appid for r in search_by_vector(c, [0.0, 0.0, 0.1], 2).collect()]
    assert [(r.mode, r.appid) for r in by[5]] == [("error", None)]


def test_search_with_unnormalised_column(spark):
    """A query vector given as a column (here a stored row, not unit length)
    gives the same result as the literal; it is normalised once."""
    from vitrine.operators.similarity import stored_vector
    c = catalog(spark, rows_basic())
    raw = spark.createDataFrame([(1, [4.0, 0.5, 0.0])], "k int, v array<double>")
    col = stored_vector(raw, 1, "k", "v", normalize=False)
    got = [(r.appid, round(r.score, 9)) for r in search_by_vector(c, col, 4).collect()]
    want = [(r.appid, round(r.score, 9)) for r in search_by_vector(c, [4.0, 0.5, 0.0], 4).collect()]
    assert got == want


def test_batch_ties_go_to_the_smaller_id(spark):
    """Equal vectors in every block: the batch form keeps what the single form does."""
    df = spark.createDataFrame([(i, "n", [0.6, 0.8]) for i in range(1, 399)], "appid bigint, name string, vec array<double>")
    df = df.repartition(7)
    seeds = spark.createDataFrame([(1,), (200,)], "seed_id bigint")
    got = {}
    for r in recommend_batch(df, seeds, 3, keep_seed=False).collect():
        got.setdefault(r.seed_id, []).append((r["rank"], r.appid))
    for seed in (1, 200):
        single = [(r["rank"], r.appid) for r in recommend_similar(df, seed, 3, keep_seed=False).collect()]
        assert sorted(got[seed]) == single


def test_batch_small_blocks(spark, monkeypatch):
    """Many blocks on either side give the rows of one block."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, "n", [float(x) for x in rng.integers(-2, 3, 3)], 0.5, i % 9) for i in range(300)],
                               "appid bigint, name string, vec array<double>, positive_ratio double, review_count bigint")
    seeds = df.select(F.col("appid").alias("seed_id")).where("seed_id % 7 = 0")
    want = sorted(map(tuple, recommend_batch(df, seeds, 4, use_blend=True).collect()))
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 700)
    monkeypatch.setattr(similarity, "SIMS_BYTES", 500)
    monkeypatch.setattr(similarity, "ROUND_BYTES", 2000)
    assert sorted(map(tuple, recommend_batch(df, seeds, 4, use_blend=True).collect())) == want


def test_graph_has_no_node_limit(spark):
    from vitrine.plans.recommend import graph_for
    df = spark.createDataFrame([(i, f"n{i}", [1.0, i / 5000]) for i in range(1, 1201)],
                               "appid bigint, name string, vec array<double>")
    nodes, edges = graph_for(df, 1, 1100, threshold=2.0)
    assert nodes.count() == 1101 and edges.count() == 1100


def test_top_k_plans_do_not_depend_on_k(spark):
    from vitrine.operators.ranking import top_k, top_k_per_group
    df = spark.range(20000).withColumn("g", F.lit(1)).repartition(4)
    for k in (10, 5000):
        one = top_k(df, [F.col("id").asc()], k)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan, k
        assert [r.id for r in one.orderBy("rank").collect()] == list(range(k))
        grouped = top_k_per_group(df, ["g"], [F.col("id").asc()], k)
        assert "__salt" in grouped._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in grouped.collect()) == list(range(k))


def test_the_catalog_is_not_shuffled_for_a_batch(spark):
    """No join, no exchange of vectors: only ids and scores are merged."""
    cat = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "appid bigint, vec array<double>")
    plan = similarity.recommend_batch(cat, spark.createDataFrame([(3,), (4,)], "seed_id bigint"), 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text
    for line in text.splitlines():
        assert not ("Exchange " in line and ("rows" in line or "vec" in line)), line


def test_vector_index(spark):
    from vitrine.operators.vector_index import VectorIndex, recall
    rng = np.random.default_rng(3)
    heart = rng.normal(size=(12, 16))
    group = np.where(rng.random(1500) < 0.35, 0, rng.integers(0, 12, 1500))  # a cell with a third of all rows
    v = heart[group] + 0.25 * rng.normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, v[i].tolist()) for i in range(1500)] + [(2000, None)]
    cat = spark.createDataFrame(rows, "appid bigint, vec array<double>").repartition(5)
    index = VectorIndex.build(cat, k=5)
    stored = index.blocks.collect()
    from vitrine.operators.similarity import _unpack
    assert sorted(i for b in stored for i in _unpack(b.rows).column("appid").to_pylist()) == list(range(1500))
    seeds = cat.where("appid % 7 = 0 and vec is not null").selectExpr("appid as qid", "vec as qvec", "appid as seed_id")
    exact = similarity.batch_neighbours(cat, seeds, 5)
    got = index.search(seeds, 5)
    row = recall(got, exact).first()
    assert row.n_queries == 215 and row.recall >= 0.9 and index.probes < len(index.centres)
    # all cells probed: the exact result, ranks and similarities included
    every = index.search(seeds, 5, probes=len(index.centres)).collect()
    want = {(r.qid, r.rank): (r.appid, round(r.similarity, 9)) for r in exact.collect()}
    assert {(r.qid, r.rank): (r.appid, round(r.similarity, 9)) for r in every} == want
    none = VectorIndex.build(cat.limit(0), k=5)
    assert none.search(seeds.limit(0), 5).count() == 0


def _block(ids, vecs, **cols):
    import pyarrow as pa
    return pa.table({"appid": pa.array(ids, pa.int64()), "vec": pa.array([v.tolist() for v in vecs], pa.list_(pa.float64())), **cols})


def _asked(ids, vecs, seeds):
    import pyarrow as pa
    return pa.table({"qid": pa.array(ids, pa.int64()), "qvec": pa.array([v.tolist() for v in vecs], pa.list_(pa.float64())),
                     "seed_id": pa.array(seeds, pa.int64())})


def _raw(table):
    import pyarrow as pa
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _peak(run):
    import tracemalloc
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _topk(blocks, asked, k, reviews_range=None, extremes=None):
    import pyarrow as pa
    best = similarity._Best("appid", "vec", True, k, reviews_range)
    run = similarity._topk_cells([_raw(asked)], best, extremes)
    batches = (pa.RecordBatch.from_pydict({"rows": pa.array([_raw(b)], pa.binary())}) for b in blocks)
    return [r for batch in run(batches) for r in batch.to_pylist()]


def test_batch_memory_of_a_task():
    """What a task holds besides its blocks does not follow their size."""
    rng = np.random.default_rng(1)
    c, q = (similarity._unit_rows(rng.normal(size=(n, 64))) for n in (8000, 8000))
    blocks, asked = [_block(range(8000), c)], _asked(range(8000), q, [None] * 8000)
    assert _peak(lambda: _topk(blocks, asked, 5)) < 90e6


def test_batch_rows_given_out():
    """A task gives out few rows for a query, however many blocks it has read."""
    rng = np.random.default_rng(2)
    c, q = (similarity._unit_rows(rng.normal(size=(n, 8))) for n in (4000, 50))
    blocks = [_block(range(at, at + 100), c[at:at + 100]) for at in range(0, 4000, 100)]
    rows = _topk(blocks, _asked(range(50), q, [None] * 50), 5)
    assert len(rows) < 50 * 5 * 40 / 4
    want = np.argsort(-(q @ c.T), axis=1)[:, :5]
    for i in range(50):
        mine = sorted((r for r in rows if r["qid"] == i), key=lambda r: (-r["similarity"], r["appid"]))[:5]
        assert [r["appid"] for r in mine] == want[i].tolist()


@pytest.mark.parametrize("blend", [False, True])
def test_batch_near_ties_and_odd_vectors(blend):
    """Scores that differ by less than single precision shows; vectors that hold no
    number; a seed's own row; equal similarities everywhere."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    base = similarity._unit_rows(rng.normal(size=(1, 16)))
    c = base + 1e-9 * rng.normal(size=(600, 16))
    c[7] = np.nan
    q = np.vstack([base, rng.normal(size=(2, 16)), np.zeros((1, 16))])
    unit = similarity._unit_rows(q)
    table = _block(range(600), c, __ratio=pa.array(rng.integers(0, 3, 600) / 2), __lc=pa.array(rng.integers(0, 3, 600) * 1.0))
    asked = _asked(range(4), q, [5, None, 7, None])
    sims = np.einsum("qj,cj->qc", unit, c)
    sims[0, 5] = sims[2, 7] = -1.0
    key, extremes = sims, None
    if blend:
        got = [r for b in similarity._minmax_cells([_raw(asked)], "appid", "vec", True)(
            iter([pa.RecordBatch.from_pydict({"rows": pa.array([_raw(table)], pa.binary())})])) for r in b.to_pylist()]
        extremes = [np.array([[r["smin"] for r in got], [r["smax"] for r in got]])]
        assert extremes[0] == pytest.approx(np.array([np.nanmin(sims, axis=1), np.nanmax(sims, axis=1)]), abs=1e-14)
        low, high = extremes[0][:, :, None]
        key = 0.6 * ((sims - low) / (high - low + 1e-8)) + (
            0.25 * table["__ratio"].to_numpy() + 0.15 * table["__lc"].to_numpy() / (2 + 1e-8))
    rows = _topk([table.slice(at, 150) for at in range(0, 600, 150)], asked, 4, (0.0, 2.0) if blend else None, extremes)
    for i in range(4):
        mine = sorted((r["score" if blend else "similarity"] for r in rows if r["qid"] == i), reverse=True)[:4]
        assert mine == pytest.approx(sorted(key[i][np.isfinite(key[i])], reverse=True)[:4], abs=2e-8 if blend else 1e-14)


def test_index_fit_in_bounded_memory():
    from vitrine.operators import vector_index
    rng = np.random.default_rng(5)
    sample = similarity._unit_rows(rng.normal(size=(20000, 8)))
    assert _peak(lambda: vector_index._fit_probes(sample, vector_index._centres(sample, 500), 5, 0.95)) < 60e6


def test_prompts_with_one_vector_are_one_search(spark, monkeypatch):
    from vitrine.plans import recommend
    c = catalog(spark, rows_basic())
    texts = spark.createDataFrame([(f"q{i}", f"text {i}") for i in range(12)], "qid string, text string")
    vectors = texts.selectExpr("qid", "array(cast(substr(qid, 2) as int) % 2, 1.0, 0.5) as qvec")
    searched = []
    plain = recommend.search_batch

    def counted(cat, q, *args):
        searched.append(q.count())
        return plain(cat, q, *args)
    monkeypatch.setattr(recommend, "search_batch", counted)
    got = {(r.qid, r["rank"]): (r.appid, r.score) for r in
           recommend.prompt_recommend(c, texts, top_k_n=3, vectors=vectors).collect()}
    assert searched == [2] and len(got) == 36
    for i in range(12):
        single = search_by_vector(c, [float(i % 2), 1.0, 0.5], 3).collect()
        assert [got[f"q{i}", r["rank"]] for r in single] == [(r.appid, pytest.approx(r.score)) for r in single]


def test_the_index_copies_no_query_per_cell(spark):
    """No join and no exchange of vectors, whatever the number of probed cells."""
    from vitrine.operators.vector_index import VectorIndex
    rng = np.random.default_rng(6)
    v = similarity._unit_rows(rng.normal(size=(300, 8)))
    cat = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "appid bigint, vec array<double>")
    index = VectorIndex.build(cat, k=3)
    text = index.search(cat.selectExpr("appid as qid", "vec as qvec"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text
    for line in text.splitlines():
        assert not ("Exchange " in line and ("rows" in line or "vec" in line)), line
