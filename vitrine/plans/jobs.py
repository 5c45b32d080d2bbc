"""End-to-end batch jobs: catalog build, review typing, summaries, aliases.

Only these functions write; every step before the write is a lazy
DataFrame from the operators. Generation functions are supplied by the
caller (one set-up per task); no model ships here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import catalog as cat
from vitrine.operators import enrich
from vitrine.schema import ALIASES_SCHEMA, SUMMARIES_SCHEMA
from vitrine.sources import csv
from vitrine.sources.pages import file_mark
from vitrine.sources.parquet import append_in_chunks, read_optional, write_overwrite

GenFactory = Callable[[], Callable[[str], str | None]]
CHUNK_ROWS = 10_000  # prompts that one commit holds, and that a lost driver repeats at most


def build_catalog_job(spark: SparkSession, apps_csv: str, app_genres_csv: str, genres_csv: str,
                      reviews: str | DataFrame, clean_out: str, stats_out: str) -> None:
    """CSV catalog + genre links + reviews -> ``apps_clean`` and
    ``apps_with_stats`` parquet. ``reviews``: a table, as
    :func:`vitrine.sources.csv.convert_reviews` gives it, or the path of a quoted
    CSV file (one task per file)."""
    apps = csv.read_catalog_csv(spark, apps_csv)
    clean = cat.build_catalog(apps, csv.read_app_genres_csv(spark, app_genres_csv),
                              csv.read_genres_csv(spark, genres_csv))
    write_overwrite(clean, clean_out)
    stats = cat.add_review_stats(spark.read.parquet(clean_out), _reviews(spark, reviews))
    write_overwrite(stats, stats_out)


def _reviews(spark: SparkSession, reviews: str | DataFrame) -> DataFrame:
    return csv.read_reviews_csv(spark, reviews) if isinstance(reviews, str) else reviews


def typed_reviews_job(spark: SparkSession, reviews: str | DataFrame, out: str) -> None:
    write_overwrite(cat.typed_reviews(_reviews(spark, reviews)), out)


def summary_job(spark: SparkSession, reviews: DataFrame, items: DataFrame, out: str,
                make_fn: GenFactory, top_n: int = 100, min_review_count: int = 50,
                key: str = "appid", chunk_rows: int = CHUNK_ROWS) -> int:
    """Resumable summaries: items already in ``out`` are skipped (they keep
    their target places), the rest get a generated summary (null on error),
    committed chunk by chunk. Returns the number of new rows."""
    done = read_optional(spark, out, SUMMARIES_SCHEMA).withColumnRenamed("appid", key)
    corpus = enrich.summary_corpus(reviews, items, done, top_n, min_review_count, key=key)
    prompts = enrich.summary_prompt(corpus).withColumn("appid", F.col(key).cast("bigint"))

    def rows(chunk: DataFrame) -> DataFrame:
        gen = enrich.generate(chunk, make_fn, "prompt", "summary")
        return enrich.with_timestamp(gen.select("appid", "name", "summary", "n_reviews_used", "n_reviews_total"))
    return append_in_chunks(spark, prompts, rows, out, "appid", SUMMARIES_SCHEMA, chunk_rows)


def alias_job(spark: SparkSession, items: DataFrame, out: str, make_fn: GenFactory,
              top_n: int = 200, min_review_count: int = 50, k: int = 6, chunk_rows: int = CHUNK_ROWS) -> int:
    """Resumable aliases: top items by review count, minus finished ones,
    prompt -> caller's generator -> parsed, cleaned alias list (empty on a
    bad or failed response), committed chunk by chunk."""
    done = read_optional(spark, out, ALIASES_SCHEMA)
    if "review_count" in items.columns:
        targets = enrich.popular_targets(items, min_review_count, top_n)
    else:
        from vitrine.operators.ranking import top_k
        targets = top_k(items, [F.col("appid").asc()], top_n, "target_rank")
    pending = targets.join(done.select("appid"), "appid", "left_anti")
    prompts = enrich.alias_prompt(pending, k).withColumn("appid", F.col("appid").cast("bigint"))

    def rows(chunk: DataFrame) -> DataFrame:
        res = enrich.alias_result(enrich.generate(chunk, make_fn, "prompt", "response"), k)
        return enrich.with_timestamp(res.select("appid", F.trim(F.col("name")).alias("name"), "aliases", "alias_text"))
    return append_in_chunks(spark, prompts, rows, out, "appid", ALIASES_SCHEMA, chunk_rows)


def incremental_load_job(spark: SparkSession, pages_path: str, store, items: DataFrame | None = None,
                         k: int | None = None, language: str | None = None) -> DataFrame:
    """The scheduled review ingest as one job: take the reviews of the page files
    that landed since the last run, upsert the new ones into ``store`` (a
    :class:`vitrine.streaming.ReviewStore` with the raw review schema), advance
    the watermarks, and return the run report per key (``appid, since, fetched,
    newest, pages``), frozen before the store changes.

    The store's versions list the files taken (path, length and time), so a run
    reads no page twice; the list becomes visible with the rows. All landed keys
    are reported. Only with ``k`` given the load is limited to the top ``k`` items
    of the catalog by review count (or the default keys); files are then noted
    with the keys that were asked for.
    """
    from vitrine.operators import ingest
    from vitrine.sources.pages import landed_files, page_reviews, read_pages
    version = store.version()
    loaded = store.loaded_files(version)
    fresh = [r.path for r in landed_files(spark, pages_path).join(
        loaded.select(F.col("path").alias("noted")), F.col("mark") == F.col("noted"), "left_anti").collect()]
    pages = read_pages(spark, fresh or pages_path)
    pages = pages.withColumn("mark", file_mark()) if fresh else pages.withColumn("mark", F.lit("")).limit(0)
    pages = pages.withColumn("appid", F.col("appid").cast("bigint"))
    keys = None
    if k is not None:
        keys = ingest.pick_keys(items, k) if items is not None else ingest.default_keys(spark, k)
        pages = pages.join(keys.select("appid"), "appid", "left_semi")
    rows = page_reviews(pages, language).select(*[F.col(f.name).cast(f.dataType) for f in store.schema.fields])
    taken = pages.groupBy("mark", "appid").agg(F.count_distinct("page_no").alias("pages"))
    # a file without a page of the asked keys is noted too
    taken = landed_files(spark, pages_path).where(F.col("path").isin(fresh)).join(taken, "mark", "left").select(
        F.col("mark").alias("path"), "appid", "pages") if fresh else None
    if taken is not None:
        taken = taken.checkpoint()
    seen = loaded.select("appid", "pages").where(F.col("appid").isNotNull())
    if taken is not None:
        seen = seen.unionByName(taken.select("appid", "pages").where(F.col("appid").isNotNull()))
    if keys is None:
        keys = seen.select("appid").distinct()
    _, state = store.current(version)
    new = ingest.incremental_rows(rows, state, ts_col=store.ts_col)
    report = ingest.run_report(keys, state, new, ts_col=store.ts_col).join(
        seen.groupBy("appid").agg(F.sum("pages").alias("pages")), "appid", "left").withColumn(
        "pages", F.coalesce("pages", F.lit(0)).cast("bigint")).checkpoint()
    if fresh:
        store.apply(rows, taken)
    return report
