"""Data-quality reports: top items with actual row counts, key coverage,
summary report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import truncate
from vitrine.operators.ranking import top_k


def top_items_counts(items: DataFrame, reviews: DataFrame, n: int = 10, key: str = "appid",
                     count_col: str = "review_count", language: str = "english") -> DataFrame:
    """Top ``n`` items by stored review count with the actual number of
    review rows (all languages and the given one) - one grouped pass over
    the reviews joined to the ``n`` keys (semi-join first, so only their
    rows are aggregated)."""
    top = top_k(items.where(F.col(key).isNotNull()),
                [F.col(count_col).desc_nulls_last(), F.col(key).asc()], n)
    top = top.select("rank", key, "name", count_col)
    r = reviews.join(top.select(key), key, "left_semi")
    lang = F.lower(F.col("language")) == F.lit(language) if "language" in reviews.columns else F.lit(False)
    counts = r.groupBy(key).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(lang).alias("n_language"))
    return (top.join(counts, key, "left")
            .select("rank", key, "name", count_col,
                    F.coalesce("n_all", F.lit(0)).cast("bigint").alias("n_all"),
                    F.coalesce("n_language", F.lit(0)).cast("bigint").alias("n_language")))


def key_coverage(items: DataFrame, reviews: DataFrame, key: str = "appid") -> DataFrame:
    """Distinct keys in each table and in both (one row). Each side is
    reduced to its distinct keys (partial aggregation) before the join."""
    a = items.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__a", F.lit(1))
    b = reviews.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__b", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count("__a").alias("keys_items"), F.count("__b").alias("keys_reviews"),
                 F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("keys_both"))


def summary_report(summaries: DataFrame, items: DataFrame, key: str = "appid",
                   preview_chars: int = 120) -> DataFrame:
    """Summaries with a text preview, left-joined to the catalog's name and
    review count (catalog name suffixed ``_apps``)."""
    s = summaries.where(F.col(key).isNotNull())
    i = items.where(F.col(key).isNotNull()).select(key, F.col("name").alias("name_apps"), "review_count")
    return (s.join(i, key, "left")
            .select(key, "name", "name_apps", "review_count", "n_reviews_used", "n_reviews_total",
                    truncate(F.col("summary").cast("string"), preview_chars).alias("summary_preview")))
