"""Incremental review ingest: per-key high watermark, dedup, upsert, state,
run report and the page stop rule.

The same operators (:func:`incremental_rows`, :func:`upsert`,
:func:`next_state`) make the bucketed store behind the batch job and the
Structured Streaming ``foreachBatch`` sink (see ``vitrine.streaming``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ranking import first_per_key
from vitrine.schema import REVIEW_JSON_SCHEMA

# --- fixed values: reviews per page, fallback keys without a catalog (must match the reference) ---
PAGE_SIZE = 100
DEFAULT_KEYS = [620, 440, 570]
# --- end fixed values ---


def pick_keys(items: DataFrame | None, k: int, key: str = "appid",
              count_col: str = "review_count") -> DataFrame:
    """Top-k keys by review count (nulls last); without a catalog, the
    default list cut to ``min(k, 3)``."""
    from vitrine.operators.ranking import top_k
    if items is None or key not in items.columns:
        raise ValueError("use default_keys(spark, k) when there is no catalog")
    cand = items.where(F.col(key).isNotNull())
    order = ([F.col(count_col).desc_nulls_last()] if count_col in cand.columns else []) + [F.col(key).asc()]
    return top_k(cand, order, k).select("rank", F.col(key).cast("bigint").alias(key))


def default_keys(spark, k: int, key: str = "appid") -> DataFrame:
    rows = [(i + 1, v) for i, v in enumerate(DEFAULT_KEYS[: min(k, 3)])]
    return spark.createDataFrame(rows, f"rank int, {key} bigint")


def with_watermark(feed: DataFrame, state: DataFrame | None, key: str = "appid",
                   wm_col: str = "last_timestamp_updated") -> DataFrame:
    """Attach each key's watermark (missing state -> 0) as ``since``."""
    if state is None:
        return feed.withColumn("since", F.lit(0).cast("bigint"))
    s = state.select(F.col(key), F.col(wm_col).alias("__wm"))
    return (feed.join(s, key, "left")
            .withColumn("since", F.coalesce(F.col("__wm"), F.lit(0)).cast("bigint")).drop("__wm"))


def incremental_rows(feed: DataFrame, state: DataFrame | None, key: str = "appid",
                     id_col: str = "recommendationid", ts_col: str = "timestamp_updated",
                     order: Sequence[Column] | None = None) -> DataFrame:
    """New rows: non-empty id, ``ts > since`` (missing ts counts as 0), one
    row per ``(key, id)`` - the first seen under ``order`` (default newest
    ``ts`` first, as the service lists pages)."""
    f = with_watermark(feed, state, key)
    f = f.where(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != ""))
    f = f.where(F.coalesce(F.col(ts_col), F.lit(0)) > F.col("since"))
    order = list(order) if order else [F.col(ts_col).desc_nulls_last()]
    return first_per_key(f, [key, id_col], order)


def upsert(existing: DataFrame | None, new_rows: DataFrame, keys: Sequence[str],
           version: Sequence[Column] | None = None) -> DataFrame:
    """Insert-or-replace by ``keys``: new rows replace existing ones.

    Without ``version`` the incoming batch wins; with ``version`` the
    highest version wins over both. Spark has no MERGE on parquet: write the
    result to a new directory and swap, never over the path being read.
    """
    new = new_rows.withColumn("__src", F.lit(1))
    if existing is None:
        both = new
    else:
        both = existing.withColumn("__src", F.lit(0)).unionByName(new, allowMissingColumns=True)
    order = (list(version) if version else []) + [F.col("__src").desc()]
    return first_per_key(both, list(keys), order).drop("__src")


def next_state(state: DataFrame | None, new_rows: DataFrame, key: str = "appid",
               ts_col: str = "timestamp_updated", wm_col: str = "last_timestamp_updated",
               run_at: Column | None = None) -> DataFrame:
    """New watermark = max(old, newest fetched); saved only for keys that
    fetched something, others keep their old row."""
    fetched = new_rows.groupBy(key).agg(F.max(ts_col).alias("__new"))
    run_at = run_at if run_at is not None else F.current_timestamp()
    if state is None:
        return fetched.select(key, F.col("__new").cast("bigint").alias(wm_col), run_at.alias("last_run_at"))
    s = state.select(key, F.col(wm_col).alias("__old"), F.col("last_run_at").alias("__at"))
    j = s.join(fetched, key, "full_outer")
    wm = F.when(F.col("__new").isNull(), F.col("__old")).otherwise(
        F.greatest(F.coalesce(F.col("__old"), F.lit(0)), F.col("__new")))
    at = F.when(F.col("__new").isNull(), F.col("__at")).otherwise(run_at)
    return j.select(key, wm.cast("bigint").alias(wm_col), at.alias("last_run_at"))


def run_report(keys: DataFrame, state: DataFrame | None, new_rows: DataFrame, key: str = "appid",
               ts_col: str = "timestamp_updated", pages: DataFrame | None = None) -> DataFrame:
    """Per requested key: ``since``, ``fetched`` and ``newest`` (the old
    watermark when nothing new arrived); with the landed ``pages`` (``page_no``)
    also ``pages``, how many of them the key has."""
    k = with_watermark(keys.select(key).distinct(), state, key)
    got = new_rows.groupBy(key).agg(F.count(F.lit(1)).alias("fetched"), F.max(ts_col).alias("__max"))
    j = k.join(got, key, "left")
    extra = []
    if pages is not None:
        landed = pages.select(F.col(key).cast(keys.schema[key].dataType).alias(key), "page_no").distinct()
        j = j.join(landed.groupBy(key).agg(F.count("page_no").alias("__pages")), key, "left")
        extra = [F.coalesce("__pages", F.lit(0)).cast("bigint").alias("pages")]
    return j.select(key, "since", F.coalesce("fetched", F.lit(0)).cast("bigint").alias("fetched"),
                    F.greatest(F.col("since"), F.coalesce(F.col("__max"), F.col("since"))).cast("bigint")
                    .alias("newest"), *extra)


def stop_rule(feed: DataFrame, state: DataFrame | None, key: str = "appid",
              ts_col: str = "timestamp_updated", page_size: int = PAGE_SIZE,
              max_pages: int | None = None, last_page_has_cursor: bool = True) -> DataFrame:
    """Pages read, rows fetched and stop cause per key for a feed served
    newest first in pages of ``page_size``.

    With pages ordered by ``ts`` descending every new row precedes every old
    one, so the page holding the first old row is ``new // page_size + 1``
    and the whole rule reduces to per-key counts: one aggregation with
    map-side combine, no sort of a key's rows (a hot key costs nothing extra).

    Causes: ``hit_old_data``; after the last data page either
    ``empty_reviews`` (the service still sent a cursor and the next page was
    empty) or, with ``last_page_has_cursor=False``, ``no_next_cursor``
    (a full last page is still followed by an empty one);
    ``max_pages_reached`` when ``max_pages`` is given and hit first (rows on
    later pages are then not fetched).
    """
    f = with_watermark(feed, state, key)
    agg = f.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(F.col(ts_col), F.lit(0)) > F.col("since")).alias("n_new"),
        F.max("since").alias("since"))
    n, new = F.col("n_rows"), F.col("n_new")
    has_old = n > new
    data_pages = F.ceil(n / page_size)
    if last_page_has_cursor:
        end_pages, end_cause = data_pages + 1, F.lit("empty_reviews")
    else:
        partial = (n % page_size) != 0
        end_pages = F.when(partial, data_pages).otherwise(data_pages + 1)
        end_cause = F.when(partial, "no_next_cursor").otherwise("empty_reviews")
    pages = F.when(has_old, F.floor(new / page_size) + 1).otherwise(end_pages)
    cause = F.when(has_old, F.lit("hit_old_data")).otherwise(end_cause)
    fetched = new
    if max_pages is not None:
        capped = pages > max_pages
        cause = F.when(capped, "max_pages_reached").otherwise(cause)
        pages = F.least(pages, F.lit(max_pages))
        fetched = F.least(new, F.lit(max_pages * page_size))
    return agg.select(key, "since", F.col("n_rows").cast("bigint").alias("n_rows"),
                      fetched.cast("bigint").alias("fetched"),
                      pages.cast("bigint").alias("pages"), cause.alias("stopped"))


# ------------------------------------------------------------------ page JSON

def _flag(c: Column) -> Column:
    """Null-preserving boolean -> 0/1."""
    return F.when(c.isNull(), None).otherwise(c.cast("int"))


def flatten_review(r: Column | str = "r") -> list[Column]:
    """Columns of the raw review table from a parsed review struct."""
    r = F.col(r) if isinstance(r, str) else r
    score = r["weighted_vote_score"]
    return [
        r["recommendationid"].cast("string").alias("recommendationid"),
        F.when(r["author"]["steamid"].isNull() | (r["author"]["steamid"] == ""), None)
        .otherwise(r["author"]["steamid"].cast("string")).alias("author_steamid"),
        r["language"].alias("language"),
        r["review"].alias("review"),
        _flag(r["voted_up"]).alias("voted_up"),
        r["votes_up"].alias("votes_up"),
        r["votes_funny"].alias("votes_funny"),
        F.nullif(score.cast("string"), F.lit("")).try_cast("double").alias("weighted_vote_score"),
        r["author"]["playtime_forever"].alias("playtime_forever"),
        r["author"]["playtime_last_two_weeks"].alias("playtime_last_two_weeks"),
        r["author"]["playtime_at_review"].alias("playtime_at_review"),
        r["timestamp_created"].alias("timestamp_created"),
        r["timestamp_updated"].alias("timestamp_updated"),
        _flag(r["steam_purchase"]).alias("steam_purchase"),
        _flag(r["received_for_free"]).alias("received_for_free"),
        _flag(r["written_during_early_access"]).alias("written_during_early_access"),
    ]


def parse_review_json(c: Column | str) -> Column:
    return F.from_json(c, REVIEW_JSON_SCHEMA)
