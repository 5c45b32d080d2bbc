"""Landed review pages (JSON files): read, explode, flatten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.ingest import flatten_review
from vitrine.schema import PAGE_JSON_SCHEMA


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON page files (one page object per line) with the page schema."""
    return spark.read.schema(PAGE_JSON_SCHEMA).json(path)


def _mark(path: Column, length: Column, modified: Column) -> Column:
    return F.concat_ws("|", path, length.cast("string"), F.unix_micros(modified).cast("string"))


def file_mark() -> Column:
    """What tells a landed file apart, for rows just read: path, length and time."""
    return _mark(F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time"))


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, mark) of the files in a landing folder, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", _mark(F.col("path"), F.col("length"), F.col("modificationTime")).alias("mark"))


def page_reviews(pages: DataFrame, language: str | None = None) -> DataFrame:
    """One raw-review row per review of every page, with ``appid`` and
    ``page_no``; optional case-insensitive language filter."""
    r = pages.select("appid", "page_no", F.explode("reviews").alias("r"))
    out = r.select(F.col("appid").cast("bigint").alias("appid"), "page_no", *flatten_review("r"))
    if language is not None:
        out = out.where(F.lower(F.col("language")) == F.lit(language.lower()))
    return out


def page_summary(pages: DataFrame) -> DataFrame:
    """Per page: review count, cursor and the reported total."""
    return pages.select("appid", "page_no", "cursor", F.size("reviews").alias("n_reviews"),
                        F.col("query_summary.total_reviews").alias("total_reviews"))
