"""Registered queries (Spark) and their DuckDB twins.

Each entry of :data:`QUERIES` is ``(spark, sf_dir) -> DataFrame`` over the
whole bound tables; :data:`ORACLE_SQL` holds the equal ANSI SQL for DuckDB
(views of the same parquet files). Column names match one to one; arrays
are compared as ``|``-joined text and doubles rounded to 6 places on both
sides (see :mod:`vitrine.plans.compare`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.dates import release_year, year_in_text
from vitrine.operators import catalog as cat
from vitrine.operators import search
from vitrine.operators import similarity as sim
from vitrine.operators.vector_index import VectorIndex, recall
from vitrine.functions.text import ALIAS_BANNED_WORDS, DEMOTED_TYPES
from vitrine.operators.filters import TRUE_TEXTS, Filters, apply_filters
from vitrine.plans import recommend as rec
from vitrine.plans.bindings import Tables
from vitrine.plans.compare import comparable


def epoch_seconds(c: str):
    """Seconds since 1970 of a wall-clock timestamp (independent of the
    session time zone)."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


# ----------------------------------------------------------------- parameters
SEED = 7
QUERY_VEC_ID = 11
HOT_YEAR = 1998
GRAPH_THRESHOLD = 0.3
NAME_QUERY = "red widget"
ALIAS_QUERY = "brand#13; promo"
FUZZY_QUERY = "redd widgett"
CATALOG_NAME_QUERY = "customer#000000"
F_YEARS = Filters(min_year=1996, max_year=1999)
F_GENRES = Filters(genres=("promo", "Economy"))
F_FREE = Filters(is_free=True)
F_RATING = Filters(min_positive_ratio=0.5)
F_REVIEWS = Filters(min_review_count=4)
F_PRICE = Filters(max_price=150000.0)
F_ALL = Filters(min_year=1995, max_year=2000, genres=("standard", "LARGE", "small"),
                is_free=False, min_positive_ratio=0.2, min_review_count=2, max_price=400000.0)

# ----------------------------------------------------------------- SQL pieces
_DEMOTED_SQL = ", ".join(f"'{x}'" for x in DEMOTED_TYPES)
_TRUE_SQL = ", ".join(f"'{x}'" for x in TRUE_TEXTS)
_APPS = """
apps AS (
  SELECT o.o_orderkey AS appid, c.c_name AS name,
         CASE WHEN o.o_orderstatus = 'P' THEN 'dlc' ELSE 'game' END AS type,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END AS is_free,
         strftime(o.o_orderdate, '%Y-%m-%d') AS release_date,
         c.c_mktsegment AS short_description,
         o.o_totalprice AS price
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
gs AS (
  SELECT l.l_orderkey AS appid, list_sort(list_distinct(list(p.p_type))) AS genres
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey),
st AS (
  SELECT l_orderkey AS appid, count(*) AS review_count,
         avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive_ratio
  FROM lineitem GROUP BY l_orderkey),
clean AS (
  SELECT a.*, g.genres, year(strptime(a.release_date, '%Y-%m-%d')) AS release_year,
         trim(lower(regexp_replace(a.name, '[^a-zA-Z0-9]+', ' ', 'g'))) AS name_normalized
  FROM apps a LEFT JOIN gs g ON a.appid = g.appid),
stats AS (
  SELECT c.*, st.review_count, st.positive_ratio FROM clean c LEFT JOIN st ON c.appid = st.appid),
emb AS (
  SELECT vec_id AS appid,
         CASE WHEN n > 0 THEN list_transform(e, lambda x: x / n)
              ELSE list_transform(e, lambda x: 0.0::DOUBLE) END AS vec
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e,
               sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS n
        FROM embeddings)),
sv AS (
  SELECT s.*, coalesce(s.genres, []::VARCHAR[]) AS genres_c, e.vec
  FROM stats s JOIN emb e ON s.appid = e.appid
  WHERE s.type = 'game')"""


def _filters_sql(f: Filters) -> str:
    conds = ["TRUE"]
    if f.min_year is not None:
        conds.append(f"coalesce(release_year, 0) >= {f.min_year}")
    if f.max_year is not None:
        conds.append(f"coalesce(release_year, 9999) <= {f.max_year}")
    if f.genres:
        wanted = ", ".join(f"'{g.lower()}'" for g in f.genres)
        conds.append(f"coalesce(list_has_any(list_transform(genres_c, lambda g: lower(g)), [{wanted}]), false)")
    if f.is_free is not None:
        conds.append(f"coalesce(lower(trim(is_free)) IN ({_TRUE_SQL}), false) = {str(bool(f.is_free)).upper()}")
    if f.min_positive_ratio is not None:
        conds.append(f"coalesce(positive_ratio, 0.0) >= {float(f.min_positive_ratio)}")
    if f.min_review_count is not None:
        conds.append(f"coalesce(review_count, 0) >= {f.min_review_count}")
    if f.max_price is not None:
        conds.append(f"coalesce(TRY_CAST(price AS DOUBLE), 'inf'::DOUBLE) <= {float(f.max_price)}")
    return " AND ".join(conds)


_REC_OUT = ("appid, name, short_description, round(similarity, 6) AS similarity, "
            "round(positive_ratio, 6) AS positive_ratio, review_count, release_year, release_date, "
            "array_to_string(genres_c, '|') AS genres")


def _rec_sql(seed_sql: str, f: Filters | None = None, blend: bool = False, keep_seed: bool = True,
             k: int = 10, extra_ctes: str = "") -> str:
    seed_rule = ("CASE WHEN appid = (SELECT appid FROM seed) THEN -1.0 ELSE sim0 END"
                 if keep_seed else "sim0")
    drop_seed = "" if keep_seed else "AND appid <> (SELECT appid FROM seed)"
    where = _filters_sql(f or Filters())
    sort = "score" if blend else "similarity"
    score = ""
    if blend:
        score = """,
mm AS (SELECT min(similarity) AS smin, max(similarity) AS smax,
              min(ln(1 + coalesce(review_count, 0))) AS cmin, max(ln(1 + coalesce(review_count, 0))) AS cmax
       FROM f),
sc AS (SELECT f.*, 0.6 * (similarity - smin) / (smax - smin + 1e-8)
                 + 0.25 * coalesce(positive_ratio, 0.5)
                 + 0.15 * (ln(1 + coalesce(review_count, 0)) - cmin) / (cmax - cmin + 1e-8) AS score
       FROM f, mm)"""
    src = "sc" if blend else "f"
    out_score = ", round(score, 6) AS score" if blend else ""
    return f"""
WITH {_APPS},{extra_ctes}
seed AS ({seed_sql}),
scored AS (
  SELECT sv.*, list_dot_product(sv.vec, (SELECT min(vec) FROM sv WHERE appid = (SELECT appid FROM seed))) AS sim0
  FROM sv),
f AS (SELECT *, {seed_rule} AS similarity FROM scored
      WHERE sim0 IS NOT NULL {drop_seed} AND {where}){score}
SELECT row_number() OVER (ORDER BY {sort} DESC NULLS LAST, appid) AS rank, {_REC_OUT}{out_score}
FROM {src}
QUALIFY rank <= {k}
"""


# ================================================================= catalog
@register("catalog_build", f"""
WITH {_APPS}
SELECT appid, name, type, is_free, release_date, short_description,
       array_to_string(genres, '|') AS genres, release_year, name_normalized
FROM clean""")
def _catalog_build(t: Tables) -> DataFrame:
    return t.apps_clean().drop("mat_final_price")


@register("review_stats", f"""
WITH {_APPS}
SELECT appid, name, review_count, round(positive_ratio, 6) AS positive_ratio FROM stats""")
def _review_stats(t: Tables) -> DataFrame:
    return t.apps_with_stats().select("appid", "name", "review_count", "positive_ratio")


@register("reviews_typed", """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS recommendationid,
       l_orderkey AS appid, l_returnflag AS language,
       TRY_CAST(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS BIGINT) AS votes_up,
       TRY_CAST(l_linestatus AS BIGINT) AS votes_funny,
       TRY_CAST(CAST(l_linenumber AS VARCHAR) AS BIGINT) AS comment_count,
       TRY_CAST(CAST(epoch(l_shipdate)::BIGINT AS VARCHAR) AS BIGINT) AS timestamp_created,
       TRY_CAST(CAST(epoch(l_shipdate)::BIGINT + l_partkey AS VARCHAR) AS BIGINT) AS timestamp_updated
FROM lineitem""")
def _reviews_typed(t: Tables) -> DataFrame:
    li = t.t("lineitem")
    raw = li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("recommendationid"),
        F.col("l_orderkey").cast("string").alias("appid"),
        F.col("l_returnflag").alias("language"),
        F.col("l_quantity").cast("bigint").cast("string").alias("votes_up"),
        F.col("l_linestatus").alias("votes_funny"),
        F.col("l_linenumber").cast("string").alias("comment_count"),
        epoch_seconds("l_shipdate").cast("string").alias("timestamp_created"),
        (epoch_seconds("l_shipdate") + F.col("l_partkey")).cast("string").alias("timestamp_updated"))
    return cat.typed_reviews(raw)


@register("serving_catalog", f"""
WITH {_APPS}
SELECT appid, name, type, release_year, array_to_string(genres_c, '|') AS genres,
       review_count, round(positive_ratio, 6) AS positive_ratio,
       round(list_sum(list_transform(vec, lambda x: x * x)), 6) AS vec_norm2
FROM sv""")
def _serving_catalog(t: Tables) -> DataFrame:
    s = t.serving()
    return s.select("appid", "name", "type", "release_year", "genres", "review_count",
                    "positive_ratio",
                    F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("vec_norm2"))


@register("serving_catalog_aliases", f"""
WITH {_APPS}
SELECT sv.appid, sv.name, coalesce(lower(p.p_brand || '; ' || p.p_type), '') AS alias_text,
       coalesce(lower(trim(p.p_brand || '; ' || p.p_type)), '') AS alias_text_normalized
FROM sv LEFT JOIN part p ON sv.appid = p.p_partkey""")
def _serving_aliases(t: Tables) -> DataFrame:
    return t.serving(with_aliases=True).select("appid", "name", "alias_text", "alias_text_normalized")


_DATE_TEXTS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MMM d, yyyy", "d MMM, yyyy", "MMMM d, yyyy",
               "d MMMM, yyyy", "MMM yyyy", "yyyy-MM", "yyyy", "'Q'q yyyy"]


@register("release_year_formats", f"""
SELECT o_orderkey AS appid, year(o_orderdate) AS pattern_year,
       CASE WHEN o_orderkey % {len(_DATE_TEXTS)} < {len(_DATE_TEXTS) - 1} THEN year(o_orderdate) END AS parsed_year
FROM orders""")
def _release_year_formats(t: Tables) -> DataFrame:
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(_DATE_TEXTS) == i, F.date_format("o_orderdate", f))
                        for i, f in enumerate(_DATE_TEXTS)])
    o = t.t("orders").select(F.col("o_orderkey").alias("appid"), text.alias("text"))
    return o.select("appid", year_in_text("text").alias("pattern_year"), release_year("text").alias("parsed_year"))


def _filter_query(name: str, f: Filters) -> None:
    sql = f"""
WITH {_APPS}
SELECT appid, name, release_year, array_to_string(genres_c, '|') AS genres, is_free,
       round(positive_ratio, 6) AS positive_ratio, review_count, round(price, 6) AS price
FROM sv WHERE {_filters_sql(f)}"""

    def fn(t: Tables) -> DataFrame:
        s = t.serving_table()
        return apply_filters(s, f).select(
            "appid", "name", "release_year", "genres", "is_free", "positive_ratio", "review_count",
            F.col("mat_final_price").try_cast("double").alias("price"))
    register(name, sql)(fn)


for _n, _f in [("filter_year_range", F_YEARS), ("filter_genres", F_GENRES), ("filter_free", F_FREE),
               ("filter_rating", F_RATING), ("filter_reviews", F_REVIEWS),
               ("filter_price", F_PRICE), ("filter_all", F_ALL)]:
    _filter_query(_n, _f)


# ================================================================= vectors
@register("l2_normalize", f"""
WITH {_APPS}
SELECT vec_id AS appid, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2,
       round(v[1], 6) AS v1, round(v[64], 6) AS v64
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(
        list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings)""")
def _l2_normalize(t: Tables) -> DataFrame:
    from vitrine.functions.vectors import l2_normalize
    e = t.t("embeddings").select(F.col("vec_id").alias("appid"), l2_normalize("embedding").alias("v"))
    return e.select("appid", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("norm2"),
                    F.col("v")[0].alias("v1"), F.col("v")[63].alias("v64"))


@register("cosine_topk", f"""
WITH {_APPS}
SELECT rank, appid, round(similarity, 6) AS similarity FROM (
  SELECT row_number() OVER (ORDER BY s DESC, appid) AS rank, appid, s AS similarity
  FROM (SELECT appid, CASE WHEN appid = {SEED} THEN -1.0 ELSE list_dot_product(vec,
          (SELECT vec FROM sv WHERE appid = {SEED})) END AS s FROM sv))
WHERE rank <= 10""")
def _cosine_topk(t: Tables) -> DataFrame:
    return sim.recommend_similar(t.serving_table(), SEED, 10).select("rank", "appid", "similarity")


# ================================================================= recommend
@register("recommend_similar", _rec_sql(f"SELECT {SEED} AS appid"))
def _recommend_similar(t: Tables) -> DataFrame:
    return sim.recommend_similar(t.serving_table(), SEED, 10)


_F_REC = Filters(min_year=1997, max_year=2000, genres=("promo", "Economy"), min_review_count=2)


@register("recommend_filtered", _rec_sql(f"SELECT {SEED} AS appid", _F_REC))
def _recommend_filtered(t: Tables) -> DataFrame:
    return sim.recommend_similar(t.serving_table(), SEED, 10, _F_REC)


_F_BLEND = Filters(min_year=1997)


@register("recommend_blended", _rec_sql(f"SELECT {SEED} AS appid", _F_BLEND, blend=True))
def _recommend_blended(t: Tables) -> DataFrame:
    return sim.recommend_similar(t.serving_table(), SEED, 10, _F_BLEND, use_blend=True)


@register("recommend_no_seed", _rec_sql(f"SELECT {SEED} AS appid", _F_BLEND, blend=True,
                                        keep_seed=False))
def _recommend_no_seed(t: Tables) -> DataFrame:
    return sim.recommend_similar(t.serving_table(), SEED, 10, _F_BLEND, use_blend=True, keep_seed=False)


def _name_seed_sql(q: str, src: str = "sv") -> str:
    return f"""
  SELECT appid FROM {src}
  WHERE contains(lower(coalesce(name, '')), '{q}') OR contains(lower(coalesce(name_normalized, '')), '{q}')
  ORDER BY (lower(coalesce(name_normalized, '')) = '{q}')::INT DESC,
           (CASE WHEN lower(coalesce(type, '')) = 'game' THEN 2 ELSE 0 END
            - CASE WHEN lower(coalesce(type, '')) IN ({_DEMOTED_SQL}) THEN 2 ELSE 0 END) DESC,
           coalesce(review_count, 0) DESC, length(coalesce(name, 'None')) ASC, appid ASC
  LIMIT 1"""


_LEGACY_PARAMS = {"name": CATALOG_NAME_QUERY, "min_year": "1996", "is_free": None, "is_multi": "true"}
_LEGACY_FILTERS = Filters(min_year=1996, is_free=False)


@register("recommend_legacy_free", _rec_sql(_name_seed_sql(CATALOG_NAME_QUERY), _LEGACY_FILTERS,
                                            blend=True))
def _recommend_legacy_free(t: Tables) -> DataFrame:
    return rec.recommend_request(t.serving_table(), _LEGACY_PARAMS, free_mode="legacy")


@register("recommend_by_name", _rec_sql(_name_seed_sql(CATALOG_NAME_QUERY)))
def _recommend_by_name(t: Tables) -> DataFrame:
    return rec.recommend_by_name(t.serving_table(), CATALOG_NAME_QUERY, 5, top_k_n=10)


@register("recommend_batch", f"""
WITH {_APPS},
pairs AS (
  SELECT a.appid AS seed_id, b.appid AS appid,
         CASE WHEN a.appid = b.appid THEN -1.0 ELSE list_dot_product(a.vec, b.vec) END AS similarity
  FROM sv a, sv b)
SELECT seed_id, rank, appid, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, appid) AS rank FROM pairs)
WHERE rank <= 5""")
def _recommend_batch(t: Tables) -> DataFrame:
    s = t.serving_table()
    return sim.recommend_batch(s, s.select(F.col("appid").alias("seed_id")), 5)


def _batch_blend_sql(queries_sql: str, f: Filters, k: int, seed_rule: bool) -> str:
    sim = ("CASE WHEN a.qid = b.appid THEN -1.0 ELSE list_dot_product(a.qv, b.vec) END"
           if seed_rule else "list_dot_product(a.qv, b.vec)")
    return f"""
WITH {_APPS},
q AS ({queries_sql}),
c AS (SELECT * FROM sv WHERE {_filters_sql(f)}),
pairs AS (SELECT a.qid, b.appid, {sim} AS similarity, b.positive_ratio, b.review_count FROM q a, c b),
mm AS (SELECT qid, min(similarity) AS smin, max(similarity) AS smax FROM pairs GROUP BY qid),
cc AS (SELECT min(ln(1 + coalesce(review_count, 0))) AS cmin, max(ln(1 + coalesce(review_count, 0))) AS cmax FROM c),
sc AS (SELECT p.qid, p.appid, p.similarity,
              0.6 * (p.similarity - mm.smin) / (mm.smax - mm.smin + 1e-8)
              + 0.25 * coalesce(p.positive_ratio, 0.5)
              + 0.15 * (ln(1 + coalesce(p.review_count, 0)) - cc.cmin) / (cc.cmax - cc.cmin + 1e-8) AS score
       FROM pairs p JOIN mm ON p.qid = mm.qid, cc)
SELECT qid, rank, appid, round(similarity, 6) AS similarity, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, appid) AS rank FROM sc)
WHERE rank <= {k}"""


@register("recommend_batch_blended", _batch_blend_sql("SELECT appid AS qid, vec AS qv FROM sv", _F_BLEND, 5, True)
          .replace("SELECT qid, rank", "SELECT qid AS seed_id, rank"))
def _recommend_batch_blended(t: Tables) -> DataFrame:
    s = t.serving_table()
    return sim.recommend_batch(s, s.select(F.col("appid").alias("seed_id")), 5, _F_BLEND, use_blend=True)


INDEX_K, INDEX_RECALL = 5, 0.9


@register("recommend_indexed", f"""
WITH {_APPS}
SELECT count(DISTINCT appid) AS n_queries, count(*) * least({INDEX_K}, count(*)) AS n_exact, TRUE AS recall_reached
FROM sv""")
def _recommend_indexed(t: Tables) -> DataFrame:
    """Every item searched through the cell index, against the exact batch."""
    s = t.serving_table()
    found = VectorIndex.build(s, k=INDEX_K).search(
        s.selectExpr("appid AS qid", "vec AS qvec", "appid AS seed_id"), INDEX_K)
    exact = sim.recommend_batch(s, s.select(F.col("appid").alias("seed_id")), INDEX_K)
    return recall(found, exact.withColumnRenamed("seed_id", "qid")).select(
        "n_queries", "n_exact", (F.col("recall") >= INDEX_RECALL).alias("recall_reached"))


_F_SBATCH = Filters(max_year=1999)


@register("search_batch", _batch_blend_sql(
    "SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings", _F_SBATCH, 3, False)
    .replace("list_dot_product(a.qv, b.vec)",
             "list_dot_product(list_transform(a.qv, lambda x: x / sqrt(list_sum(list_transform(a.qv, lambda y: y * y)))), b.vec)"))
def _search_batch(t: Tables) -> DataFrame:
    q = t.t("embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return sim.search_batch(t.serving_table(), q, 3, _F_SBATCH)


_SEARCH_OUT = ("appid, name, short_description, round(similarity, 6) AS similarity, round(score, 6) AS score, "
               "round(positive_ratio, 6) AS positive_ratio, review_count, release_date, "
               "array_to_string(genres_c, '|') AS genres")


def _search_sql(f: Filters) -> str:
    return f"""
WITH {_APPS},
q AS (SELECT list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(
        list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS qv FROM embeddings WHERE vec_id = {QUERY_VEC_ID}),
f AS (SELECT sv.*, list_dot_product(sv.vec, (SELECT qv FROM q)) AS similarity FROM sv WHERE {_filters_sql(f)}),
mm AS (SELECT min(similarity) AS smin, max(similarity) AS smax,
              min(ln(1 + coalesce(review_count, 0))) AS cmin, max(ln(1 + coalesce(review_count, 0))) AS cmax
       FROM f),
sc AS (SELECT f.*, 0.6 * (similarity - smin) / (smax - smin + 1e-8)
                 + 0.25 * coalesce(positive_ratio, 0.5)
                 + 0.15 * (ln(1 + coalesce(review_count, 0)) - cmin) / (cmax - cmin + 1e-8) AS score
       FROM f, mm)
SELECT row_number() OVER (ORDER BY score DESC, appid) AS rank, {_SEARCH_OUT}
FROM sc QUALIFY rank <= 10"""


def _query_vec(t: Tables):
    return sim.stored_vector(t.t("embeddings"), QUERY_VEC_ID, "vec_id", "embedding")


@register("search_by_vector", _search_sql(Filters()))
def _search_by_vector(t: Tables) -> DataFrame:
    return sim.search_by_vector(t.serving_table(), _query_vec(t), 10, normalized=True)


_F_SEARCH = Filters(max_year=1999, min_review_count=3)


@register("search_by_vector_filtered", _search_sql(_F_SEARCH))
def _search_by_vector_filtered(t: Tables) -> DataFrame:
    return sim.search_by_vector(t.serving_table(), _query_vec(t), 10, _F_SEARCH, normalized=True)


# ================================================================= graph
_GRAPH_RECS = f"""
WITH {_APPS},
recs AS (
  SELECT row_number() OVER (ORDER BY similarity DESC, appid) AS rank, appid, name, similarity, vec FROM (
    SELECT appid, name, vec, CASE WHEN appid = {SEED} THEN -1.0 ELSE list_dot_product(vec,
             (SELECT vec FROM sv WHERE appid = {SEED})) END AS similarity FROM sv)
  QUALIFY rank <= 10)"""


@register("similarity_graph_nodes", _GRAPH_RECS + f"""
SELECT CAST({SEED} AS VARCHAR) AS id, (SELECT min(name) FROM sv WHERE appid = {SEED}) AS label, 0 AS "group", 0 AS rank
UNION ALL
SELECT CAST(appid AS VARCHAR) AS id, name AS label, 1 AS "group", rank FROM recs""")
def _graph_nodes(t: Tables) -> DataFrame:
    nodes, _ = rec.graph_for(t.serving_table(), SEED, 10, threshold=GRAPH_THRESHOLD)
    return nodes


@register("similarity_graph_edges", _GRAPH_RECS + f"""
SELECT CAST({SEED} AS VARCHAR) AS source, CAST(appid AS VARCHAR) AS target, round(similarity, 6) AS value FROM recs
UNION ALL
SELECT CAST(a.appid AS VARCHAR), CAST(b.appid AS VARCHAR), round(list_dot_product(a.vec, b.vec), 6)
FROM recs a JOIN recs b ON b.rank > a.rank
WHERE list_dot_product(a.vec, b.vec) >= {GRAPH_THRESHOLD}""")
def _graph_edges(t: Tables) -> DataFrame:
    _, edges = rec.graph_for(t.serving_table(), SEED, 10, threshold=GRAPH_THRESHOLD)
    return edges


# ================================================================= popularity
@register("year_hot", f"""
WITH {_APPS}
SELECT rank, appid, name, round(popularity, 6) AS popularity, review_count, round(positive_ratio, 6) AS positive_ratio
FROM (SELECT row_number() OVER (ORDER BY popularity DESC, appid) AS rank, * FROM (
        SELECT appid, name, coalesce(review_count, 0) AS review_count, coalesce(positive_ratio, 0.0) AS positive_ratio,
               0.6 * ln(1 + coalesce(review_count, 0)) + 0.4 * coalesce(positive_ratio, 0.0) AS popularity
        FROM sv WHERE release_year = {HOT_YEAR}))
WHERE rank <= 10""")
def _year_hot(t: Tables) -> DataFrame:
    return rec.year_hot(t.serving_table(), HOT_YEAR)


@register("top_items_by_reviews", f"""
WITH {_APPS}
SELECT rank, appid, name, review_count FROM (
  SELECT row_number() OVER (ORDER BY review_count DESC NULLS LAST, appid) AS rank, appid, name, review_count
  FROM stats WHERE appid IS NOT NULL)
WHERE rank <= 10""")
def _top_items(t: Tables) -> DataFrame:
    from vitrine.operators.ranking import top_k
    s = t.apps_with_stats().where(F.col("appid").isNotNull())
    return top_k(s, [F.col("review_count").desc_nulls_last(), F.col("appid").asc()], 10) \
        .select("rank", "appid", "name", "review_count")


# ================================================================= name search
_PARTS = """
pcount AS (SELECT l_partkey AS appid, count(*) AS review_count FROM lineitem GROUP BY l_partkey),
items AS (
  SELECT p.p_partkey AS appid, p.p_name AS name,
         CASE WHEN p.p_type = 'PROMO' THEN 'demo' ELSE 'game' END AS type,
         lower(p.p_brand || '; ' || p.p_type) AS alias_text,
         pc.review_count,
         trim(lower(regexp_replace(p.p_name, '[^a-zA-Z0-9]+', ' ', 'g'))) AS name_normalized
  FROM part p LEFT JOIN pcount pc ON p.p_partkey = pc.appid)"""

_RANK_ORDER = f"""(lower(coalesce(name_normalized, '')) = '{{q}}')::INT DESC,
  (CASE WHEN lower(coalesce(type, '')) = 'game' THEN 2 ELSE 0 END
   - CASE WHEN lower(coalesce(type, '')) IN ({_DEMOTED_SQL}) THEN 2 ELSE 0 END) DESC,
  coalesce(review_count, 0) DESC, length(coalesce(name, 'None')) ASC, appid ASC"""


def _find_sql(q: str) -> str:
    return f"""
WITH {_PARTS}
SELECT row_number() OVER (ORDER BY {_RANK_ORDER.format(q=q)}) AS rank, appid, name, 'substring' AS match_stage
FROM items
WHERE contains(lower(coalesce(name, '')), '{q}') OR contains(lower(coalesce(name_normalized, '')), '{q}')
   OR contains(lower(coalesce(alias_text, '')), '{q}')
QUALIFY rank <= 5"""


@register("find_by_name_contains", _find_sql(NAME_QUERY))
def _find_contains(t: Tables) -> DataFrame:
    return search.find_by_name(t.named_items(), NAME_QUERY, 5, reviews=t.part_reviews())


@register("find_by_name_alias", _find_sql(ALIAS_QUERY))
def _find_alias(t: Tables) -> DataFrame:
    return search.find_by_name(t.named_items(), ALIAS_QUERY, 5, reviews=t.part_reviews())


def _similar_sql(q: str) -> str:
    n = "lower(coalesce(name_normalized, ''))"
    return f"(1.0::DOUBLE - levenshtein({n}, {q})::DOUBLE / greatest(length({n}), length({q}), 1))"


@register("find_by_name_fuzzy", f"""
WITH {_PARTS},
short AS (SELECT *, row_number() OVER (ORDER BY {_similar_sql(f"'{FUZZY_QUERY}'")} DESC, appid) AS place
          FROM items QUALIFY place <= 50)
SELECT row_number() OVER (ORDER BY {_RANK_ORDER.format(q=FUZZY_QUERY)}) AS rank, appid, name, 'fuzzy' AS match_stage
FROM short QUALIFY rank <= 5""")
def _find_fuzzy(t: Tables) -> DataFrame:
    return search.find_by_name(t.named_items(), FUZZY_QUERY, 5, reviews=t.part_reviews())


@register("find_by_name_batch", f"""
WITH {_PARTS},
qs AS (SELECT 'b' || p_brand AS qid, lower(trim(p_brand)) AS q FROM (SELECT DISTINCT p_brand FROM part)
       UNION ALL SELECT 'n' || n_name, lower(trim(n_name)) FROM nation
       UNION ALL SELECT 's' || s_suppkey, right(s_name, 2) FROM supplier),
s1 AS (SELECT qid, q, items.*, 'substring' AS match_stage FROM qs JOIN items
       ON contains(lower(coalesce(name, '')), q) OR contains(lower(coalesce(name_normalized, '')), q)
          OR contains(lower(coalesce(alias_text, '')), q)),
s2 AS (SELECT qid, q, items.*, 'fuzzy' AS match_stage FROM qs, items WHERE qid NOT IN (SELECT qid FROM s1)
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_similar_sql('q')} DESC, appid) <= 50)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY {_RANK_ORDER.replace("'{q}'", "q")}) AS rank,
       appid, name, match_stage
FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) QUALIFY rank <= 5""")
def _find_batch(t: Tables) -> DataFrame:
    asked = (t.t("part").select("p_brand").distinct().select(F.concat(F.lit("b"), "p_brand").alias("qid"),
                                                             F.col("p_brand").alias("text"))
             .unionByName(t.t("nation").select(F.concat(F.lit("n"), "n_name").alias("qid"), F.col("n_name").alias("text")))
             .unionByName(t.t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("qid"),
                                                 F.expr("right(s_name, 2)").alias("text"))))
    return search.find_by_name_batch(t.named_items(), asked, 5, reviews=t.part_reviews())


# ================================================================= baseline
# The baseline recommender: every item with a vector (no type filter), plain
# cosine order, unranked substring search.
_BASE = """
b AS (SELECT a.appid, a.name, a.short_description, e.vec FROM apps a JOIN emb e ON a.appid = e.appid)"""


@register("baseline_recommend", f"""
WITH {_APPS},{_BASE}
SELECT rank, appid, name, round(similarity, 6) AS similarity FROM (
  SELECT row_number() OVER (ORDER BY s DESC, appid) AS rank, appid, name, s AS similarity
  FROM (SELECT appid, name, CASE WHEN appid = {SEED} THEN -1.0 ELSE list_dot_product(vec,
          (SELECT vec FROM b WHERE appid = {SEED})) END AS s FROM b))
WHERE rank <= 10""")
def _baseline_recommend(t: Tables) -> DataFrame:
    return sim.recommend_similar(t.baseline_catalog(), SEED, 10, strict=True) \
        .select("rank", "appid", "name", "similarity")


@register("baseline_search", f"""
WITH {_APPS},{_BASE},
q AS (SELECT list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(
        list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS qv FROM embeddings WHERE vec_id = {QUERY_VEC_ID})
SELECT rank, appid, name, short_description, round(similarity, 6) AS similarity FROM (
  SELECT row_number() OVER (ORDER BY similarity DESC, appid) AS rank, appid, name, short_description, similarity
  FROM (SELECT appid, name, short_description, list_dot_product(vec, (SELECT qv FROM q)) AS similarity FROM b))
WHERE rank <= 10""")
def _baseline_search(t: Tables) -> DataFrame:
    return sim.search_by_vector(t.baseline_catalog(), _query_vec(t), 10, normalized=True, use_blend=False) \
        .select("rank", "appid", "name", "short_description", "similarity")


@register("baseline_find_by_name", f"""
WITH {_APPS},{_BASE},
hits AS (SELECT DISTINCT appid, name FROM b WHERE name IS NOT NULL
         AND contains(lower(name), '{CATALOG_NAME_QUERY}'))
SELECT rank, appid, name FROM (
  SELECT row_number() OVER (ORDER BY appid, name) AS rank, appid, name FROM hits)
WHERE rank <= 5""")
def _baseline_find(t: Tables) -> DataFrame:
    return search.find_by_name_simple(t.baseline_catalog(), CATALOG_NAME_QUERY, 5)


# ================================================================= free text
_PROMPTS_SQL = """
q AS (
  SELECT 'b' || CAST(item_id AS VARCHAR) AS qid, text FROM benchmark
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), c_name FROM customer
  UNION ALL SELECT 'k' || CAST(vec_id AS VARCHAR), CAST(vec_id AS VARCHAR) FROM embeddings),
byk AS (SELECT appid AS k, min(name) AS kname FROM sv GROUP BY appid),
byn AS (SELECT lower(name) AS n, arg_min(appid, appid) AS mid, arg_min(name, appid) AS mname
        FROM sv WHERE name IS NOT NULL GROUP BY lower(name)),
qq AS (SELECT qid, text, trim(coalesce(text, '')) AS t FROM q),
modes AS (
  SELECT qid, text,
         CASE WHEN t = '' THEN 'error' WHEN byk.k IS NOT NULL THEN 'appid'
              WHEN byn.mid IS NOT NULL THEN 'name' ELSE 'semantic' END AS mode,
         CASE WHEN byk.k IS NOT NULL THEN byk.k ELSE byn.mid END AS center_appid,
         CASE WHEN byk.k IS NOT NULL THEN byk.kname ELSE byn.mname END AS center_name
  FROM qq
  LEFT JOIN byk ON CASE WHEN regexp_full_match(t, '[0-9]+') THEN TRY_CAST(t AS BIGINT) END = byk.k
  LEFT JOIN byn ON lower(t) = byn.n)"""


def _prompts(t: Tables) -> DataFrame:
    return (t.t("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), "text")
            .unionByName(t.t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("qid"),
                                                F.col("c_name").alias("text")))
            .unionByName(t.t("embeddings").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("qid"),
                                                  F.col("vec_id").cast("string").alias("text"))))


@register("prompt_resolve", f"""
WITH {_APPS},{_PROMPTS_SQL}
SELECT qid, text, mode, center_appid, center_name FROM modes""")
def _prompt_resolve(t: Tables) -> DataFrame:
    return search.resolve_prompts(_prompts(t), t.serving_table())


PROMPT_K = 3


def _prompt_vectors(t: Tables) -> DataFrame:
    """Vectors of the request texts: the stored vector whose place among all is the
    request's number."""
    e = t.t("embeddings")
    n = e.select(F.count("*")).scalar()
    number = F.substring("qid", 2, 18).cast("bigint")
    asked = _prompts(t).select("qid", (number % n).alias("vec_id"))
    return asked.join(e, "vec_id").select("qid", F.col("embedding").alias("qvec"))


@register("prompt_recommend", f"""
WITH {_APPS},{_PROMPTS_SQL},
seeds AS (SELECT DISTINCT center_appid AS seed FROM modes WHERE mode IN ('appid', 'name')),
near AS (SELECT seed, b.appid, CASE WHEN seed = b.appid THEN -1.0 ELSE list_dot_product(a.vec, b.vec) END AS similarity
         FROM seeds JOIN sv a ON a.appid = seed, sv b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, appid) AS rank FROM near
           QUALIFY rank <= {PROMPT_K}),
unit AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(
           list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS qv FROM embeddings),
pairs AS (SELECT m.qid, b.appid, list_dot_product(u.qv, b.vec) AS similarity, b.positive_ratio, b.review_count
          FROM modes m JOIN unit u ON u.vec_id = CAST(substr(m.qid, 2) AS BIGINT) % (SELECT count(*) FROM embeddings), sv b
          WHERE m.mode = 'semantic'),
mm AS (SELECT qid, min(similarity) AS smin, max(similarity) AS smax FROM pairs GROUP BY qid),
cc AS (SELECT min(ln(1 + coalesce(review_count, 0))) AS cmin, max(ln(1 + coalesce(review_count, 0))) AS cmax FROM sv),
sc AS (SELECT p.qid, p.appid, p.similarity,
              0.6 * (p.similarity - mm.smin) / (mm.smax - mm.smin + 1e-8)
              + 0.25 * coalesce(p.positive_ratio, 0.5)
              + 0.15 * (ln(1 + coalesce(p.review_count, 0)) - cc.cmin) / (cc.cmax - cc.cmin + 1e-8) AS score
       FROM pairs p JOIN mm ON p.qid = mm.qid, cc),
found AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, appid) AS rank FROM sc
          QUALIFY rank <= {PROMPT_K})
SELECT qid, mode, center_appid, rank, appid, round(similarity, 6) AS similarity, NULL::DOUBLE AS score
FROM modes JOIN ranked ON center_appid = seed WHERE mode IN ('appid', 'name')
UNION ALL SELECT qid, 'semantic', NULL, rank, appid, round(similarity, 6), round(score, 6) FROM found
UNION ALL SELECT qid, mode, NULL, NULL, NULL, NULL, NULL FROM modes WHERE mode = 'error'""")
def _prompt_recommend(t: Tables) -> DataFrame:
    return rec.prompt_recommend(t.serving_table(), _prompts(t), top_k_n=PROMPT_K, vectors=_prompt_vectors(t))


# ================================================================= enrichment
from vitrine.operators import enrich  # noqa: E402
from vitrine.operators import ingest  # noqa: E402
from vitrine.operators import quality  # noqa: E402

SUMMARY_TOP, SUMMARY_MIN, SUMMARY_PREV_TOP = 10, 10, 5
_NL2 = "chr(10) || chr(10)"

_TEXTS = """
it AS (SELECT source AS item, count(*) AS review_count, upper(source) AS name FROM documents GROUP BY source),
en AS (SELECT source AS item, doc_id, text, n_chars FROM documents WHERE lang = 'en')"""


def _corpus_sql(top: int, per_item: int | None = 80, max_chars: int | None = 12000) -> str:
    body = f"string_agg(b.text, {_NL2} ORDER BY b.rn)"
    cut = body if max_chars is None else f"left({body}, {max_chars})"
    limit = "" if per_item is None else f"WHERE b.rn <= {per_item}"
    return f"""
tg{top} AS (SELECT item, row_number() OVER (ORDER BY review_count DESC, item) AS target_rank
          FROM it WHERE review_count >= {SUMMARY_MIN} QUALIFY target_rank <= {top}),
best{top} AS (SELECT item, text, row_number() OVER (PARTITION BY item ORDER BY n_chars DESC, doc_id DESC, doc_id) AS rn
            FROM en WHERE text IS NOT NULL AND item IN (SELECT item FROM tg{top})),
corpus{top} AS (
  SELECT b.item, coalesce(it.name, 'item=' || b.item) AS name,
         {cut} AS corpus,
         count(*) AS n_reviews_used, coalesce(it.review_count, count(*)) AS n_reviews_total,
         CAST(length({body}) AS BIGINT) AS n_chars_total, length({body}) > length({cut}) AS truncated
  FROM best{top} b LEFT JOIN it ON b.item = it.item
  {limit} GROUP BY b.item, it.name, it.review_count)"""


def _corpus(t: Tables, top: int = SUMMARY_TOP, done: DataFrame | None = None) -> DataFrame:
    return enrich.summary_corpus(t.review_texts(), t.text_items(), done, top, SUMMARY_MIN, key="item")


@register("summary_corpus", f"WITH {_TEXTS},{_corpus_sql(SUMMARY_TOP)} SELECT * FROM corpus{SUMMARY_TOP}")
def _summary_corpus(t: Tables) -> DataFrame:
    return _corpus(t)


@register("summary_corpus_whole", f"""
WITH {_TEXTS},{_corpus_sql(SUMMARY_TOP, None, None)}
SELECT item, name, md5(corpus) AS corpus_md5, n_reviews_used, n_reviews_total, n_chars_total, truncated
FROM corpus{SUMMARY_TOP}""")
def _summary_corpus_whole(t: Tables) -> DataFrame:
    whole = enrich.summary_corpus(t.review_texts(), t.text_items(), None, SUMMARY_TOP, SUMMARY_MIN, None, None, key="item")
    return whole.withColumn("corpus_md5", F.md5("corpus")).drop("corpus")


@register("summary_pending", f"""
WITH {_TEXTS},{_corpus_sql(SUMMARY_TOP)},{_corpus_sql(SUMMARY_PREV_TOP)}
SELECT item, target_rank FROM tg{SUMMARY_TOP}
WHERE item NOT IN (SELECT item FROM corpus{SUMMARY_PREV_TOP}) AND item IN (SELECT item FROM en)""")
def _summary_pending(t: Tables) -> DataFrame:
    eng = enrich.english_only(t.review_texts())
    targets = enrich.popular_targets(t.text_items(), SUMMARY_MIN, SUMMARY_TOP, "item")
    done = _corpus(t, SUMMARY_PREV_TOP)
    return enrich.pending_targets(targets, done, eng, "item").select("item", "target_rank")


def _sql_text(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


@register("summary_prompt", f"""
WITH {_TEXTS},{_corpus_sql(SUMMARY_TOP)}
SELECT item, n_reviews_used,
       {_sql_text('<system>' + chr(10) + enrich.SUMMARY_SYSTEM + chr(10) + '</system>' + chr(10) + '<user>' + chr(10) + 'Summarise the reviews of ')}
       || name || {_sql_text(enrich.SUMMARY_TEMPLATE.split('{name}')[1].split('{corpus}')[0])}
       || corpus || {_sql_text(chr(10) + '</user>')} AS prompt
FROM corpus{SUMMARY_TOP}""")
def _summary_prompt(t: Tables) -> DataFrame:
    return enrich.summary_prompt(_corpus(t)).select("item", "n_reviews_used", "prompt")


ALIAS_TOP, ALIAS_MIN = 200, 5


@register("alias_prompt", f"""
WITH {_APPS}
SELECT appid, prompt FROM (
  SELECT appid, row_number() OVER (ORDER BY review_count DESC, appid) AS target_rank,
    'Give up to 6 short search aliases players type for this product, as JSON {{"aliases": [...]}}.' || chr(10)
    || 'Name: ' || coalesce(trim(name), '') || chr(10)
    || 'Description: ' || left(coalesce(short_description, ''), 6000) || chr(10)
    || 'Genres: ' || left(coalesce(array_to_string(list_filter(list_transform(genres, lambda x: trim(x)), lambda x: x <> ''), ', '), ''), 500) || chr(10)
    || 'Extra: ' AS prompt
  FROM stats WHERE review_count >= {ALIAS_MIN} AND trim(name) <> ''
  QUALIFY target_rank <= {ALIAS_TOP})""")
def _alias_prompt(t: Tables) -> DataFrame:
    # ranked on the review counts alone; names and genre sets only for the targets
    stats = cat.review_stats(t.reviews())
    ranked = enrich.popular_targets(t.applications().select("appid").join(stats, "appid"), ALIAS_MIN, ALIAS_TOP)
    apps = t.applications().join(F.broadcast(ranked.select("appid")), "appid", "left_semi")  # ALIAS_TOP rows
    links = t.application_genres().join(F.broadcast(ranked.select("appid")), "appid", "left_semi")
    return enrich.alias_prompt(cat.build_catalog(apps, links, t.genres())).select("appid", "prompt")


def _count_text():
    return lambda text: f"Output: n{len(text)}"


@register("generate_memo", """
SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN 'n' || length(text) END AS rewritten FROM conversations""")
def _generate_memo(t: Tables) -> DataFrame:
    turns = t.t("conversations").select("conv_id", "turn", "text")
    return enrich.generate_distinct(turns, _count_text).select("conv_id", "turn", "rewritten")


# responses derived from part rows: valid JSON with noise, no JSON, broken
# JSON and a non-list field, chosen by part type
_RESP_SQL = """
resp AS (
  SELECT p_partkey AS appid, p_name AS name,
    CASE p_type
      WHEN 'SMALL' THEN 'no json here'
      WHEN 'LARGE' THEN 'Aliases: {"aliases": ["' || p_name || '", '
      WHEN 'MEDIUM' THEN '{"aliases": "' || p_name || '"}'
      ELSE 'Sure!' || chr(10) || '{"aliases": ["' || p_name || '", "' || upper(p_brand) || '", "'
           || p_type || ' ' || p_name || '", "Best ' || p_name || '", "' || p_brand || p_type || '", "'
           || p_name || ' ' || p_name || ' ' || p_name || '", "' || p_brand || ' ' || CAST(p_size AS VARCHAR)
           || '", "' || lower(p_brand) || ' ' || CAST(p_size AS VARCHAR) || '", "  ", "' || lower(p_name) || '!", "'
           || 'the ' || replace(p_name, ' ', '-') || '", "' || 'x/' || p_type || '"]}' || chr(10) || 'Done.'
    END AS response
  FROM part)"""


def _responses(t: Tables) -> DataFrame:
    p = t.t("part")
    n, b, ty, sz = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    good = F.concat(
        F.lit('Sure!\n{"aliases": ["'), n, F.lit('", "'), F.upper(b), F.lit('", "'),
        ty, F.lit(" "), n, F.lit('", "Best '), n, F.lit('", "'), b, ty, F.lit('", "'),
        n, F.lit(" "), n, F.lit(" "), n, F.lit('", "'), b, F.lit(" "), sz,
        F.lit('", "'), F.lower(b), F.lit(" "), sz, F.lit('", "  ", "'), F.lower(n), F.lit('!", "'),
        F.lit("the "), F.regexp_replace(n, " ", "-"), F.lit('", "'), F.lit("x/"), ty, F.lit('"]}\nDone.'))
    resp = (F.when(ty == "SMALL", F.lit("no json here"))
            .when(ty == "LARGE", F.concat(F.lit('Aliases: {"aliases": ["'), n, F.lit('", ')))
            .when(ty == "MEDIUM", F.concat(F.lit('{"aliases": "'), n, F.lit('"}')))
            .otherwise(good))
    return p.select(F.col("p_partkey").alias("appid"), F.col("p_name").alias("name"), resp.alias("response"))


_PARSED_SQL = """
parsed AS (
  SELECT appid, name,
    coalesce(CASE WHEN regexp_matches(response, '(?s)\\{.*\\}')
                  THEN TRY_CAST(json_extract(regexp_extract(response, '(?s)(\\{.*\\})', 1), '$.aliases') AS VARCHAR[]) END,
             []::VARCHAR[]) AS raw
  FROM resp)"""


@register("alias_parse", f"""
WITH {_RESP_SQL},{_PARSED_SQL}
SELECT appid, len(raw) AS n_raw, array_to_string(raw, '|') AS raw_aliases FROM parsed""")
def _alias_parse(t: Tables) -> DataFrame:
    from vitrine.functions.text import aliases_from_response
    r = _responses(t).withColumn("raw", aliases_from_response("response"))
    return r.select("appid", F.size("raw").cast("bigint").alias("n_raw"),
                    F.col("raw").alias("raw_aliases"))


def _norm_sql(x: str) -> str:
    s = f"regexp_replace(regexp_replace(trim({x}), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"
    s = f"lower({s})"
    s = f"regexp_replace({s}, '[-_/]+', ' ', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9\\s+]', '', 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    return s


_BANNED_SQL = " OR ".join(f"contains(p.norm, '{w}')" for w in
                          ALIAS_BANNED_WORDS)


@register("alias_clean", f"""
WITH {_RESP_SQL},{_PARSED_SQL},
pairs AS (
  SELECT appid, name, lower(trim(coalesce(name, ''))) AS orig,
         list_transform(raw, lambda a: {{'raw': trim(a), 'norm': {_norm_sql('a')}}}) AS prs
  FROM parsed),
kept AS (
  SELECT appid, name,
    list_transform(list_filter(prs, lambda p: p.raw IS NOT NULL AND p.raw <> ''
        AND NOT (orig <> '' AND lower(p.raw) = orig)
        AND NOT (orig <> '' AND {_norm_sql('orig')} = p.norm)
        AND NOT (p.norm = '' OR length(p.norm) > 32 OR len(string_split(p.norm, ' ')) > 5
                 OR regexp_matches(p.raw, '[a-z][A-Z]')
                 OR (NOT contains(p.norm, ' ') AND length(p.norm) >= 10)
                 OR {_BANNED_SQL})), lambda p: p.norm) AS norms
  FROM pairs),
dedup AS (
  SELECT appid, name, list_slice(list_filter(norms, lambda x, i: list_position(norms, x) = i), 1, 6) AS aliases
  FROM kept)
SELECT appid, name, array_to_string(aliases, '|') AS aliases, array_to_string(aliases, '; ') AS alias_text
FROM dedup""")
def _alias_clean(t: Tables) -> DataFrame:
    return enrich.alias_result(_responses(t)).select("appid", "name", "aliases", "alias_text")


# ================================================================= summaries
@register("summary_lookup", f"""
WITH {_TEXTS},{_corpus_sql(SUMMARY_TOP)}
SELECT item, name, corpus AS summary, n_reviews_used, n_reviews_total FROM corpus{SUMMARY_TOP}
WHERE contains(lower(name), 'src1')
ORDER BY n_reviews_used DESC, item LIMIT 1""")
def _summary_lookup(t: Tables) -> DataFrame:
    s = _corpus(t).withColumnRenamed("corpus", "summary")
    return search.summary_lookup(s, "SRC1", key="item")


@register("summary_report", f"""
WITH {_TEXTS},{_corpus_sql(SUMMARY_TOP)}
SELECT c.item, c.name, it.name AS name_apps, it.review_count, c.n_reviews_used, c.n_reviews_total,
       left(c.corpus, 120) AS summary_preview
FROM corpus{SUMMARY_TOP} c LEFT JOIN it ON c.item = it.item""")
def _summary_report(t: Tables) -> DataFrame:
    s = _corpus(t).withColumnRenamed("corpus", "summary")
    return quality.summary_report(s, t.text_items(), key="item")


# ================================================================= quality
@register("quality_counts", f"""
WITH {_TEXTS},
top AS (SELECT row_number() OVER (ORDER BY review_count DESC NULLS LAST, item) AS rank, item, name, review_count
        FROM it QUALIFY rank <= 10)
SELECT rank, top.item, name, review_count, coalesce(count(d.doc_id), 0) AS n_all,
       coalesce(count(d.doc_id) FILTER (WHERE d.lang = 'en'), 0) AS n_language
FROM top LEFT JOIN documents d ON d.source = top.item
GROUP BY rank, top.item, name, review_count""")
def _quality_counts(t: Tables) -> DataFrame:
    return quality.top_items_counts(t.text_items(), t.review_texts(), 10, key="item")


@register("key_coverage", """
SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS keys_items,
       (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS keys_reviews,
       (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders
                              INTERSECT SELECT DISTINCT l_orderkey FROM lineitem)) AS keys_both""")
def _key_coverage(t: Tables) -> DataFrame:
    return quality.key_coverage(t.apps_clean(), t.reviews())


# ================================================================= ingest
INGEST_CUTOFF = "2024-01-15 00:00:00"

_FEED_SQL = f"""
feed AS (SELECT user_id AS appid, CAST(event_id AS VARCHAR) AS recommendationid,
                CAST(floor(epoch(ts)) AS BIGINT) AS timestamp_updated, event_type AS language FROM events),
prev AS (SELECT appid, max(timestamp_updated) AS wm FROM feed
         WHERE timestamp_updated < CAST(epoch(TIMESTAMP '{INGEST_CUTOFF}') AS BIGINT) GROUP BY appid),
w AS (SELECT feed.*, coalesce(prev.wm, 0) AS since FROM feed LEFT JOIN prev ON feed.appid = prev.appid),
new AS (SELECT * FROM w WHERE recommendationid IS NOT NULL AND recommendationid <> ''
        AND coalesce(timestamp_updated, 0) > since
        QUALIFY row_number() OVER (PARTITION BY appid, recommendationid ORDER BY timestamp_updated DESC) = 1)"""


def _feed(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.t("events")
    feed = e.select(F.col("user_id").alias("appid"), F.col("event_id").cast("string").alias("recommendationid"),
                    epoch_seconds("ts").alias("timestamp_updated"), F.col("event_type").alias("language"))
    cutoff = F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'{INGEST_CUTOFF}')")
    earlier = feed.where(F.col("timestamp_updated") < cutoff)
    state = ingest.next_state(None, earlier, run_at=F.lit(None).cast("timestamp"))
    return feed, state


@register("ingest_incremental", f"""
WITH {_FEED_SQL}
SELECT appid, recommendationid, timestamp_updated, language, since FROM new""")
def _ingest_incremental(t: Tables) -> DataFrame:
    feed, state = _feed(t)
    return ingest.incremental_rows(feed, state)


@register("ingest_state", f"""
WITH {_FEED_SQL},
got AS (SELECT appid, max(timestamp_updated) AS mx FROM new GROUP BY appid)
SELECT coalesce(prev.appid, got.appid) AS appid,
       CASE WHEN got.mx IS NULL THEN prev.wm ELSE greatest(coalesce(prev.wm, 0), got.mx) END AS last_timestamp_updated
FROM prev FULL OUTER JOIN got ON prev.appid = got.appid""")
def _ingest_state(t: Tables) -> DataFrame:
    feed, state = _feed(t)
    new = ingest.incremental_rows(feed, state)
    return ingest.next_state(state, new).select("appid", "last_timestamp_updated")


@register("ingest_report", f"""
WITH {_FEED_SQL},
k AS (SELECT DISTINCT appid FROM feed),
got AS (SELECT appid, count(*) AS fetched, max(timestamp_updated) AS mx FROM new GROUP BY appid)
SELECT k.appid, coalesce(prev.wm, 0) AS since, coalesce(got.fetched, 0) AS fetched,
       greatest(coalesce(prev.wm, 0), coalesce(got.mx, coalesce(prev.wm, 0))) AS newest
FROM k LEFT JOIN prev ON k.appid = prev.appid LEFT JOIN got ON k.appid = got.appid""")
def _ingest_report(t: Tables) -> DataFrame:
    feed, state = _feed(t)
    new = ingest.incremental_rows(feed, state)
    return ingest.run_report(feed.select("appid"), state, new)


INGEST_MAX_PAGES = 10


@register("ingest_stop_rule", f"""
WITH {_FEED_SQL},
a AS (SELECT appid, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(timestamp_updated, 0) > since) AS n_new,
             max(since) AS since FROM w GROUP BY appid),
b AS (SELECT *, CASE WHEN n_rows > n_new THEN floor(n_new / 100) + 1 ELSE ceil(n_rows / 100) + 1 END AS p0,
             CASE WHEN n_rows > n_new THEN 'hit_old_data' ELSE 'empty_reviews' END AS c0 FROM a)
SELECT appid, since, n_rows, least(n_new, {INGEST_MAX_PAGES * 100}) AS fetched,
       CAST(least(p0, {INGEST_MAX_PAGES}) AS BIGINT) AS pages,
       CASE WHEN p0 > {INGEST_MAX_PAGES} THEN 'max_pages_reached' ELSE c0 END AS stopped
FROM b""")
def _ingest_stop_rule(t: Tables) -> DataFrame:
    feed, state = _feed(t)
    return ingest.stop_rule(feed, state, max_pages=INGEST_MAX_PAGES)


@register("upsert_latest", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def _upsert_latest(t: Tables) -> DataFrame:
    li = t.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                "l_shipdate", "l_returnflag")
    old = F.col("l_returnflag").eqNullSafe("N")
    existing, batch = li.where(old).drop("l_returnflag"), li.where(~old).drop("l_returnflag")
    out = ingest.upsert(existing, batch, ["l_orderkey", "l_linenumber"],
                        [F.col("l_shipdate").desc(), F.col("l_partkey").desc(), F.col("l_suppkey").desc()])
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


_JSON_SQL = """
j AS (SELECT user_id AS appid, event_id,
  '{"recommendationid": "' || CAST(event_id AS VARCHAR) || '", "language": "' || event_type || '", "review": "'
  || props || '", "voted_up": ' || CASE event_type WHEN 'purchase' THEN 'true' WHEN 'error' THEN 'null' ELSE 'false' END
  || ', "votes_up": ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
  || ', "weighted_vote_score": "' || CASE WHEN event_type = 'view' THEN '' ELSE CAST(value AS VARCHAR) END
  || '", "timestamp_updated": ' || CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
  || ', "steam_purchase": ' || CASE WHEN event_type = 'signup' THEN 'null' ELSE 'true' END
  || ', "author": {"steamid": "' || CAST(user_id AS VARCHAR) || '", "playtime_forever": '
  || CAST(user_id * 10 AS VARCHAR) || '}}' AS review_json
  FROM events)"""


# three batches of one feed: all reviews, then an edit of every other line of each
# order, then an edit of the orders divisible by three; an edit flips the vote
@register("store_stats", f"""
WITH votes AS (
  SELECT l_orderkey AS appid, l_linenumber, max(l_returnflag) = 'A' AS up FROM lineitem GROUP BY l_orderkey, l_linenumber),
last AS (
  SELECT appid, CASE WHEN appid % 3 = 0 THEN NOT up WHEN l_linenumber % 2 = 0 THEN NOT up ELSE up END AS up FROM votes)
SELECT appid, count(*) AS review_count, avg(CASE WHEN up THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive_ratio
FROM last GROUP BY appid""")
def _store_stats(t: Tables) -> DataFrame:
    """Statistics kept by the store through an initial load and two batches with
    replacements, against the full recomputation."""
    from vitrine.session import checkpoint_path, ensure_checkpoint_dir
    from vitrine.streaming.ingest_stream import ReviewStore
    lines = t.t("lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_returnflag") == "A").alias("up"))
    feed = lines.select(F.col("l_orderkey").alias("appid"), F.col("l_linenumber").cast("string").alias("recommendationid"),
                        F.lit(1).cast("bigint").alias("timestamp_updated"), F.col("up").cast("string").alias("voted_up"),
                        (F.col("l_linenumber") % 2 == 0).alias("__even"))
    flipped = (~F.col("voted_up").cast("boolean")).cast("string")
    rows = feed.drop("__even")
    ensure_checkpoint_dir(t.spark)
    store = ReviewStore(t.spark, checkpoint_path(t.spark, f"store-{uuid.uuid4().hex[:12]}"), rows.schema,
                        n_buckets=16, n_parts=2)
    store.apply(rows)
    store.apply(feed.where("__even").drop("__even").withColumns(
        {"timestamp_updated": F.lit(2).cast("bigint"), "voted_up": flipped}))
    store.apply(feed.where("appid % 3 = 0").drop("__even").withColumns(
        {"timestamp_updated": F.lit(3).cast("bigint"), "voted_up": flipped}))
    return store.stats()


@register("json_flatten", """
SELECT CAST(event_id AS VARCHAR) AS recommendationid, CAST(user_id AS VARCHAR) AS author_steamid,
       event_type AS language, props AS review,
       CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN NULL ELSE 0 END AS voted_up,
       CAST(floor(value) AS BIGINT) AS votes_up,
       CASE WHEN event_type = 'view' THEN NULL ELSE round(value, 6) END AS weighted_vote_score,
       user_id * 10 AS playtime_forever,
       CAST(floor(epoch(ts)) AS BIGINT) AS timestamp_updated,
       CASE WHEN event_type = 'signup' THEN NULL ELSE 1 END AS steam_purchase
FROM events""")
def _json_flatten(t: Tables) -> DataFrame:
    e = t.t("events")
    q = F.lit('"')
    js = F.concat(
        F.lit('{"recommendationid": "'), F.col("event_id").cast("string"), F.lit('", "language": "'),
        F.col("event_type"), F.lit('", "review": "'), F.regexp_replace("props", '"', '\\\\"'), q,
        F.lit(', "voted_up": '),
        F.when(F.col("event_type") == "purchase", "true").when(F.col("event_type") == "error", "null")
        .otherwise("false"),
        F.lit(', "votes_up": '), F.floor("value").cast("string"),
        F.lit(', "weighted_vote_score": "'),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("value").cast("string")),
        F.lit('", "timestamp_updated": '), epoch_seconds("ts").cast("string"),
        F.lit(', "steam_purchase": '),
        F.when(F.col("event_type") == "signup", "null").otherwise("true"),
        F.lit(', "author": {"steamid": "'), F.col("user_id").cast("string"),
        F.lit('", "playtime_forever": '), (F.col("user_id") * 10).cast("string"), F.lit("}}"))
    flat = e.select(ingest.parse_review_json(js).alias("r")).select(*ingest.flatten_review("r"))
    return flat.select("recommendationid", "author_steamid", "language", "review", "voted_up", "votes_up",
                       "weighted_vote_score", "playtime_forever", "timestamp_updated", "steam_purchase")


@register("json_records", f"""
WITH {_APPS}
SELECT appid, coalesce(short_description, '') AS short_description,
       CASE WHEN isnan(odds) OR isinf(odds) THEN NULL ELSE round(odds, 6) END AS odds,
       round(positive_ratio, 6) AS positive_ratio
FROM (SELECT appid, short_description, positive_ratio,
             CASE WHEN 1 - positive_ratio = 0 THEN 'inf'::DOUBLE ELSE positive_ratio / (1 - positive_ratio) END AS odds
      FROM sv)""")
def _json_records(t: Tables) -> DataFrame:
    from vitrine.sources.records import ieee_divide, json_safe
    s = t.serving_table()
    df = s.select("appid", "short_description", "positive_ratio",
                  ieee_divide(F.col("positive_ratio"), F.lit(1.0) - F.col("positive_ratio")).alias("odds"))
    return json_safe(df).select("appid", "short_description", "odds", "positive_ratio")
