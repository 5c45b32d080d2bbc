"""Catalog tables: clean catalog with genres, review statistics, typed
reviews, serving catalog with unit vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.dates import release_year_of
from vitrine.functions.text import (clean_array, clean_lower, empty_string_array,
                                    normalize_name, parse_list_text)
from vitrine.functions.vectors import l2_normalize
from vitrine.operators.ranking import first_per_key
from vitrine.schema import CATALOG_COLUMNS, REVIEW_CASTS, REVIEW_COLUMNS, canonical_key_of, require_columns, try_integral


def genre_sets(app_genres: DataFrame, genres: DataFrame, key: str = "appid") -> DataFrame:
    """``(appid, genres)``: sorted set of genre names per item.

    The bridge is left-joined to the genre dimension (unknown ids give null
    names, which the set drops). ``collect_set`` aggregates map-side first,
    so a hot item ships one small set per task, not its rows.
    """
    # distinct (id, name) pairs: copies in the dimension do not multiply the
    # bridge rows (the set is the same)
    dim = genres.withColumnRenamed("id", "genre_id").select("genre_id", "name").distinct()
    return (app_genres.select(key, "genre_id")
            .join(dim, "genre_id", "left")
            .groupBy(key)
            .agg(F.sort_array(F.collect_set("name")).alias("genres")))


def build_catalog(apps: DataFrame, app_genres: DataFrame, genres: DataFrame,
                  columns: Sequence[str] = CATALOG_COLUMNS, key: str = "appid") -> DataFrame:
    """Clean catalog: fixed projection + ``genres`` + ``release_year`` +
    ``name_normalized``. Items without genres get a null list."""
    require_columns(apps, [key, "name"], "catalog")
    require_columns(app_genres, [key, "genre_id"], "genre links")
    sets = genre_sets(app_genres, genres, key)
    keep = [c for c in columns if c in apps.columns]
    out = apps.select(*keep).join(sets, key, "left")
    out = out.select(*keep, "genres")
    if "release_date" in out.columns:
        out = out.withColumn("release_year", release_year_of(out, "release_date"))
    else:
        out = out.withColumn("release_year", F.lit(None).cast("int"))
    return out.withColumn("name_normalized", normalize_name("name"))


def positive_flag(voted_up: str = "voted_up"):
    """1.0 when the text is "true" in any case, else 0.0 (null counts as 0)."""
    return F.when(F.lower(F.col(voted_up).cast("string")) == "true", 1.0).otherwise(0.0)


def review_stats(reviews: DataFrame, key: str = "appid", voted_up: str = "voted_up") -> DataFrame:
    """``(appid, review_count, positive_ratio)`` with partial aggregation."""
    return (reviews.groupBy(key)
            .agg(F.count(F.lit(1)).alias("review_count"),
                 F.avg(positive_flag(voted_up)).alias("positive_ratio")))


def add_review_stats(catalog: DataFrame, reviews: DataFrame, key: str = "appid",
                     voted_up: str = "voted_up") -> DataFrame:
    """Left join of the statistics: items without reviews keep null stats."""
    return catalog.join(review_stats(reviews, key, voted_up), key, "left")


def typed_reviews(reviews: DataFrame, columns: Sequence[str] = REVIEW_COLUMNS,
                  casts: dict[str, str] = REVIEW_CASTS) -> DataFrame:
    """Fixed projection with ``try_cast`` of the numeric columns (bad text -> null)."""
    keep = [c for c in columns if c in reviews.columns]
    out = []
    for c in keep:
        if c in casts and casts[c] in ("int", "bigint", "smallint", "tinyint"):
            out.append(try_integral(c, casts[c]).alias(c))
        elif c in casts:
            out.append(F.col(c).cast("string").try_cast(casts[c]).alias(c))
        else:
            out.append(F.col(c))
    return reviews.select(*out)


def dedup_aliases(aliases: DataFrame, key: str = "appid") -> DataFrame:
    """One alias row per key (latest ``last_updated``, then alias text) with a
    normalised search text."""
    keep = [key] + [c for c in ("aliases", "alias_text", "last_updated") if c in aliases.columns]
    a = aliases.select(*keep)
    a = a.withColumn(key, canonical_key_of(a, key))
    order = []
    if "last_updated" in a.columns:
        order.append(F.col("last_updated").desc_nulls_last())
    if "alias_text" in a.columns:
        order.append(F.col("alias_text").asc_nulls_last())
    a = first_per_key(a, [key], order or [F.lit(0)])
    if "aliases" not in a.columns:
        a = a.withColumn("aliases", empty_string_array())
    if "alias_text" not in a.columns:
        a = a.withColumn("alias_text", F.lit(""))
    return a.select(key, "aliases", "alias_text")


def serving_catalog(catalog: DataFrame, embeddings: DataFrame, aliases: DataFrame | None = None,
                    item_type: str | None = "game", key: str = "appid",
                    emb_key: str = "appid", emb_col: str = "embedding",
                    emb_order: str | None = "vector_index") -> DataFrame:
    """Items with a unit vector ``vec``, ready for similarity queries.

    aliases (left, deduplicated) -> embeddings (inner: items without a vector
    vanish) -> type filter -> release year -> clean genre list -> unit vector.
    Duplicate vectors per key: the one with the highest ``emb_order`` wins.
    Build it once and store it (bucketed by key) for serving.
    """
    require_columns(catalog, [key], "catalog")
    require_columns(embeddings, [emb_key, emb_col], "embeddings")
    apps = catalog.withColumn(key, canonical_key_of(catalog, key))
    if aliases is not None:
        apps = apps.join(dedup_aliases(aliases, key), key, "left")
        apps = (apps.withColumn("aliases", F.coalesce("aliases", empty_string_array()))
                .withColumn("alias_text", F.coalesce(F.col("alias_text"), F.lit(""))))
        apps = apps.withColumn("alias_text_normalized", clean_lower("alias_text"))
    emb = embeddings.select(canonical_key_of(embeddings, emb_key).alias(key), F.col(emb_col).alias("__emb"),
                            *([F.col(emb_order).alias("__ord")] if emb_order else []))
    if emb_order:
        emb = first_per_key(emb, [key], [F.col("__ord").desc_nulls_last()]).drop("__ord")
    else:
        emb = first_per_key(emb, [key], [F.xxhash64("__emb")])
    out = apps.join(emb, key, "inner")
    if item_type is not None and "type" in out.columns:
        out = out.where(F.col("type") == F.lit(item_type))
    if "release_date" in out.columns:
        out = out.withColumn("release_year", release_year_of(out, "release_date"))
    if "genres" in out.columns:
        gtype = out.schema["genres"].dataType
        g = clean_array("genres") if isinstance(gtype, T.ArrayType) else parse_list_text("genres")
        out = out.withColumn("genres", F.coalesce(g, empty_string_array()))
    else:
        out = out.withColumn("genres", empty_string_array())
    return out.withColumn("vec", l2_normalize("__emb")).drop("__emb")
