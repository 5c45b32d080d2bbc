"""Composite recommendation queries built from the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scoring import popularity
from vitrine.operators.filters import Filters, parse_filters
from vitrine.operators.ranking import first_per_key, top_k
from vitrine.operators.enrich import encode, generate_distinct
from vitrine.operators.search import find_by_name, first_candidate, resolve_prompts
from vitrine.operators.similarity import (recommend_batch, recommend_similar, search_batch,
                                          similarity_graph)

# --- fixed values: hot list size, name candidates of a request ---
HOT_LIST_SIZE = 10
REQUEST_CANDIDATES = 3
# --- end fixed values ---


def recommend_by_name(catalog: DataFrame, name: str, top_k_candidates: int = 5,
                      search_items: DataFrame | None = None, **kwargs) -> DataFrame:
    """Seed = best name match (resolved once, then a literal), then
    ``recommend_similar``. No match gives an empty result."""
    items = search_items if search_items is not None else catalog
    seed = first_candidate(find_by_name(items, name, top_k_candidates))
    return recommend_similar(catalog, seed, **kwargs)


def recommend_request(catalog: DataFrame, params: Mapping[str, object], top_k_n: int = 10,
                      free_mode: str = "tristate", keep_seed: bool = True) -> DataFrame:
    """A recommend request given as text parameters (``name``, filters,
    ``is_free``, ``is_multi``). ``free_mode="legacy"`` reproduces the form's
    rule that an unchecked free box excludes free items once any option is
    set. A blank name raises ``ValueError``."""
    name = str(params.get("name", "") or "").strip()
    if not name:
        raise ValueError("Missing name")
    filters, blend = parse_filters(params, free_mode)
    seed = first_candidate(find_by_name(catalog, name, REQUEST_CANDIDATES))
    return recommend_similar(catalog, seed, top_k_n, filters, use_blend=blend, keep_seed=keep_seed)


def graph_for(catalog: DataFrame, seed_id, top_k_n: int = 10, filters: Filters | None = None,
              use_blend: bool = False, threshold: float = 0.7,
              keep_seed: bool = True) -> tuple[DataFrame, DataFrame]:
    recs = recommend_similar(catalog, seed_id, top_k_n, filters, use_blend, keep_seed=keep_seed)
    name = catalog.where(F.col("appid") == F.lit(seed_id)).select(F.min("name")).scalar()
    return similarity_graph(catalog, recs, seed_id, name, threshold, keep_seed)


def graph_request(catalog: DataFrame, params: Mapping[str, object], top_k_n: int = 10,
                  threshold: float = 0.7, free_mode: str = "legacy",
                  keep_seed: bool = True) -> tuple[DataFrame, DataFrame]:
    """A graph request given as text parameters: the seed is the best of the
    name candidates (resolved once), filters and ``is_multi`` as in
    :func:`recommend_request` (the graph form's two-state free box by
    default), then :func:`graph_for`. A blank name raises ``ValueError``."""
    name = str(params.get("name", "") or "").strip()
    if not name:
        raise ValueError("Missing name")
    filters, blend = parse_filters(params, free_mode)
    seed = first_candidate(find_by_name(catalog, name, REQUEST_CANDIDATES))
    return graph_for(catalog, seed, top_k_n, filters, blend, threshold, keep_seed)


def year_hot(catalog: DataFrame, year: int | Column, n: int = HOT_LIST_SIZE) -> DataFrame:
    """Top items of a release year by 0.6*log1p(reviews) + 0.4*ratio."""
    df = (catalog.withColumn("review_count", F.coalesce(F.col("review_count"), F.lit(0)))
          .withColumn("positive_ratio", F.coalesce(F.col("positive_ratio"), F.lit(0.0)))
          .withColumn("popularity", popularity("review_count", "positive_ratio"))
          .where(F.col("release_year") == F.lit(year)))
    ranked = top_k(df, [F.col("popularity").desc(), F.col("appid").asc()], n)
    return ranked.select("rank", "appid", "name", "popularity", "review_count", "positive_ratio")


def prompt_recommend(catalog: DataFrame, queries: DataFrame,
                     make_encoder: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None,
                     make_rewriter: Callable[[], Callable[[str], str | None]] | None = None,
                     top_k_n: int = 10, text_col: str = "text", qid: str = "qid",
                     key: str = "appid", vectors: DataFrame | None = None) -> DataFrame:
    """Free-text requests end to end, for a table of ``(qid, text)``.

    Each text is classified (:func:`resolve_prompts`): an item id or an exact
    name gets that item's similar items (one exact batch for all such
    requests, one query per distinct item); any other text is rewritten once
    per distinct text by the caller's function (optional; a failed or empty
    rewrite keeps the text), encoded by the caller's encoder (or looked up in
    ``vectors``, a table (qid, qvec) of texts encoded before) and searched once
    per distinct vector (blended, as the single form). Blank texts give a row with mode
    ``error`` and no recommendation.

    Output: ``qid, mode, center_appid, rank, appid, similarity, score``
    (``score`` only for semantic rows).
    """
    # classified once and written to the shared checkpoint folder: three
    # branches read it, and a lost executor does not re-run the lookups
    modes = resolve_prompts(queries, catalog, text_col, qid, key).checkpoint()
    id_type = catalog.schema[key].dataType.simpleString()
    seeded = modes.where(F.col("mode").isin("appid", "name"))
    recs = recommend_batch(catalog, seeded.select(F.col("center_appid").alias("seed_id")).distinct(), top_k_n)
    by_seed = (seeded.select(qid, "mode", "center_appid")
               .join(recs.withColumnRenamed("seed_id", "center_appid"), "center_appid", "inner")
               .select(qid, "mode", "center_appid", "rank", key, "similarity",
                       F.lit(None).cast("double").alias("score")))
    sem = modes.where(F.col("mode") == "semantic").select(qid, "text")
    if make_rewriter is not None:
        sem = generate_distinct(sem, make_rewriter, "text", "rewritten").select(qid, F.col("rewritten").alias("text"))
    if vectors is not None:
        vecs = vectors.select("qid", "qvec").join(sem.select(F.col(qid).alias("qid")), "qid", "left_semi")
    elif make_encoder is not None:
        vecs = encode(sem, make_encoder, "text", "qvec").select(F.col(qid).alias("qid"), "qvec")
    else:
        raise ValueError("texts need an encoder or vectors")
    # one search per distinct vector, handed out to the requests that share it; a
    # request with several vectors keeps the one that the batch search would
    vecs = first_per_key(vecs.where(F.col("qvec").isNotNull()), ["qid"], [F.xxhash64("qvec").asc()])
    vecs = vecs.checkpoint()
    searched = vecs.groupBy("qvec").agg(F.min("qid").alias("__one")).checkpoint()
    asked = vecs.join(searched, "qvec").select("qid", "__one")
    found = search_batch(catalog, searched.select(F.col("__one").alias("qid"), "qvec"), top_k_n)
    hits = (asked.join(found.withColumnRenamed("qid", "__one"), "__one").drop("__one").withColumnRenamed("qid", qid)
            .select(qid, F.lit("semantic").alias("mode"), F.lit(None).cast(id_type).alias("center_appid"),
                    "rank", key, "similarity", "score"))
    errors = modes.where(F.col("mode") == "error").select(
        qid, "mode", F.lit(None).cast(id_type).alias("center_appid"), F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast(id_type).alias(key), F.lit(None).cast("double").alias("similarity"),
        F.lit(None).cast("double").alias("score"))
    return by_seed.unionByName(hits).unionByName(errors)
