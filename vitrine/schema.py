"""Table schemas, the canonical key type and optional-column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: column names of the source tables (must match the data) ---
CATALOG_COLUMNS = [
    "appid", "name", "type", "is_free", "release_date", "required_age",
    "short_description", "supported_languages", "header_image", "background",
    "metacritic_score", "recommendations_total", "mat_supports_windows",
    "mat_supports_mac", "mat_supports_linux", "mat_initial_price",
    "mat_final_price", "mat_discount_percent", "mat_currency",
    "mat_achievement_count", "mat_pc_os_min", "mat_pc_processor_min",
    "mat_pc_memory_min", "mat_pc_graphics_min", "mat_pc_os_rec",
    "mat_pc_processor_rec", "mat_pc_memory_rec", "mat_pc_graphics_rec",
    "created_at", "updated_at",
]

REVIEW_COLUMNS = [
    "recommendationid", "appid", "author_steamid", "author_num_games_owned",
    "author_num_reviews", "author_playtime_forever",
    "author_playtime_last_two_weeks", "author_playtime_at_review",
    "author_last_played", "language", "review_text", "timestamp_created",
    "timestamp_updated", "voted_up", "votes_up", "votes_funny",
    "weighted_vote_score", "comment_count", "steam_purchase",
    "received_for_free", "written_during_early_access", "created_at",
    "updated_at",
]

# typed review columns: name -> target type (all others stay string)
REVIEW_CASTS = {
    "appid": "int",
    "votes_up": "bigint",
    "votes_funny": "bigint",
    "comment_count": "bigint",
    "timestamp_created": "bigint",
    "timestamp_updated": "bigint",
}
# --- end fixed values ---

KEY_TYPE = T.LongType()


def all_string_schema(columns: Iterable[str]) -> T.StructType:
    """Header CSV files are read with every column as text (no inference)."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


CATALOG_CSV_SCHEMA = all_string_schema(CATALOG_COLUMNS)
REVIEWS_CSV_SCHEMA = all_string_schema(REVIEW_COLUMNS)
APP_GENRES_CSV_SCHEMA = all_string_schema(["appid", "genre_id"])
GENRES_CSV_SCHEMA = all_string_schema(["id", "name"])
EMBEDDING_MAP_CSV_SCHEMA = all_string_schema(["appid", "vector_index"])

EMBEDDINGS_SCHEMA = T.StructType([
    T.StructField("appid", T.StringType(), True),
    T.StructField("vector_index", T.LongType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])

SUMMARIES_SCHEMA = T.StructType([
    T.StructField("appid", T.LongType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("n_reviews_used", T.LongType(), True),
    T.StructField("n_reviews_total", T.LongType(), True),
    T.StructField("last_updated", T.TimestampType(), True),
])

ALIASES_SCHEMA = T.StructType([
    T.StructField("appid", T.LongType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("aliases", T.ArrayType(T.StringType()), True),
    T.StructField("alias_text", T.StringType(), True),
    T.StructField("last_updated", T.TimestampType(), True),
])

REVIEWS_RAW_SCHEMA = T.StructType([
    T.StructField("appid", T.LongType(), False),
    T.StructField("recommendationid", T.StringType(), False),
    T.StructField("author_steamid", T.StringType(), True),
    T.StructField("language", T.StringType(), True),
    T.StructField("review", T.StringType(), True),
    T.StructField("voted_up", T.IntegerType(), True),
    T.StructField("votes_up", T.LongType(), True),
    T.StructField("votes_funny", T.LongType(), True),
    T.StructField("weighted_vote_score", T.DoubleType(), True),
    T.StructField("playtime_forever", T.LongType(), True),
    T.StructField("playtime_last_two_weeks", T.LongType(), True),
    T.StructField("playtime_at_review", T.LongType(), True),
    T.StructField("timestamp_created", T.LongType(), True),
    T.StructField("timestamp_updated", T.LongType(), True),
    T.StructField("steam_purchase", T.IntegerType(), True),
    T.StructField("received_for_free", T.IntegerType(), True),
    T.StructField("written_during_early_access", T.IntegerType(), True),
])

CRAWL_STATE_SCHEMA = T.StructType([
    T.StructField("appid", T.LongType(), False),
    T.StructField("last_timestamp_updated", T.LongType(), True),
    T.StructField("last_run_at", T.TimestampType(), True),
])

_AUTHOR = T.StructType([
    T.StructField("steamid", T.StringType(), True),
    T.StructField("playtime_forever", T.LongType(), True),
    T.StructField("playtime_last_two_weeks", T.LongType(), True),
    T.StructField("playtime_at_review", T.LongType(), True),
])

REVIEW_JSON_SCHEMA = T.StructType([
    T.StructField("recommendationid", T.StringType(), True),
    T.StructField("language", T.StringType(), True),
    T.StructField("review", T.StringType(), True),
    T.StructField("voted_up", T.BooleanType(), True),
    T.StructField("votes_up", T.LongType(), True),
    T.StructField("votes_funny", T.LongType(), True),
    # kept as text: the service sends it as a quoted number, sometimes ""
    T.StructField("weighted_vote_score", T.StringType(), True),
    T.StructField("timestamp_created", T.LongType(), True),
    T.StructField("timestamp_updated", T.LongType(), True),
    T.StructField("steam_purchase", T.BooleanType(), True),
    T.StructField("received_for_free", T.BooleanType(), True),
    T.StructField("written_during_early_access", T.BooleanType(), True),
    T.StructField("author", _AUTHOR, True),
])

PAGE_JSON_SCHEMA = T.StructType([
    T.StructField("appid", T.LongType(), True),
    T.StructField("page_no", T.LongType(), True),
    T.StructField("cursor", T.StringType(), True),
    T.StructField("reviews", T.ArrayType(REVIEW_JSON_SCHEMA), True),
    T.StructField("query_summary", T.StructType([
        T.StructField("total_reviews", T.LongType(), True)]), True),
])


def has(df: DataFrame, column: str) -> bool:
    """Optional-column test, decided once at plan-building time."""
    return column in df.columns


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Column presence gate: raise ``ValueError`` naming the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing column(s): {', '.join(missing)}")


# Text an integral try_cast can accept: padding (<= 0x20 or ISO control
# characters), an optional sign, ASCII digits. Spark's try_cast to an integer
# type fails through an exception path (slow per row); checking the shape
# first sends only plausible numbers to it, with identical results.
_INT_TEXT = r"^[\x00-\x20\x7f-\x9f]*[+-]?[0-9]+[\x00-\x20\x7f-\x9f]*$"
_NUM_TEXT = (r"^[\x00-\x20\x7f-\x9f]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
             r"[\x00-\x20\x7f-\x9f]*$")


def try_integral(c: Column | str, type_name: str = "bigint") -> Column:
    """``try_cast`` of text to an integral type (bad text -> null)."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return F.when(text.rlike(_INT_TEXT), text.try_cast(type_name))


def canonical_key(c: Column | str) -> Column:
    """One key type everywhere: BIGINT through ``try_cast`` (bad text -> null).

    Text such as ``"620.0"`` is read through DOUBLE first, as a numeric
    coercion would.
    """
    c = F.col(c) if isinstance(c, str) else c
    as_text = F.trim(c.cast("string"))
    as_double = F.when(as_text.rlike(_NUM_TEXT), as_text.try_cast("double"))
    return F.coalesce(try_integral(as_text), as_double.try_cast("bigint"))


def canonical_key_of(df: DataFrame, key: str) -> Column:
    """``canonical_key`` chosen at plan time: integral columns are only widened
    (keeps filter pushdown), text goes through ``try_cast``."""
    dt = df.schema[key].dataType
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(key).cast("bigint")
    return canonical_key(key)


def with_canonical_key(df: DataFrame, key: str = "appid", drop_null: bool = True) -> DataFrame:
    out = df.withColumn(key, canonical_key_of(df, key))
    return out.where(F.col(key).isNotNull()) if drop_null else out
