"""Incremental review ingest: a versioned store and the streams that feed it.

Landed review files arrive in a folder. ``readStream`` picks up new files,
``trigger(availableNow=True)`` processes everything present and stops, and a
``foreachBatch`` sink runs the same batch function as the batch job:
watermark filter, dedup, upsert, state advance.

Storage (:class:`ReviewStore`): immutable folders and manifests
(:mod:`vitrine.sources.versions`). The reviews and the watermark state are bucketed:
by the hash of the key, and for reviews also by the hash of the review id, so the
reviews of one hot item are spread over ``n_parts`` buckets. A batch first reads
only the *key columns* of the buckets its rows fall into. Rows whose key is new are
added in folders of their own; only buckets that hold a replaced review are read
whole, upserted, and written anew. An insert-heavy feed writes about its own size, a
small update about the buckets of its reviews. Writes are rebalanced by size: a large
bucket is written by several tasks, small ones share one.

Each upsert also writes its change feed (for every review that came or went its key
and the ``feed`` columns, with op ``add`` or ``retract``), and from it the review
statistics are kept up to date: one row of differences per touched item, added up when
read (:meth:`ReviewStore.stats`). Reviews, state, statistics, feed and the list of
loaded files become visible together, by one rename.

Fault tolerance: the stream checkpoint records which files each batch consumed. A
batch that crashed before its commit left nothing behind; one that is run again after
its commit finds its rows at or below the watermark and changes nothing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.ingest import incremental_rows, next_state, upsert
from vitrine.schema import CRAWL_STATE_SCHEMA, PAGE_JSON_SCHEMA
from vitrine.session import checkpoint_path
from vitrine.sources.pages import page_reviews
from vitrine.sources.versions import BUCKET, Version, VersionLog

DEFAULT_BUCKETS = 256
DEFAULT_PARTS = 16
FILES_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("appid", T.LongType()),
                             T.StructField("pages", T.LongType())])
ADD, RETRACT = "add", "retract"


def bucket_of(key: str, n_buckets: int, row_id: str | None = None, n_parts: int = 1):
    """Bucket of a key, or of a review: one of ``n_parts`` of its key's."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(n_buckets))
    if row_id is not None:
        bucket = bucket * n_parts + F.pmod(F.xxhash64(F.col(row_id)), F.lit(n_parts))
    return bucket.cast("int")


class ReviewStore:
    """Reviews, watermark state, change feed and statistics under one root."""

    def __init__(self, spark: SparkSession, root: str, row_schema: T.StructType,
                 keys=("appid", "recommendationid"), key: str = "appid",
                 ts_col: str = "timestamp_updated", n_buckets: int = DEFAULT_BUCKETS,
                 n_parts: int = DEFAULT_PARTS, voted_col: str = "voted_up", feed: tuple[str, ...] = ()):
        self.spark, self.root, self.schema = spark, root, row_schema
        self.keys, self.key, self.ts_col = tuple(keys), key, ts_col
        self.n_buckets, self.n_parts = n_buckets, n_parts
        self.log = VersionLog(spark, root)
        self.voted_col = voted_col if voted_col in row_schema.names else None
        shown = dict.fromkeys([*self.keys, ts_col, *([voted_col] if self.voted_col else []), *feed])
        self.feed_schema = T.StructType([T.StructField("op", T.StringType())] + [row_schema[c] for c in shown])
        self.state_schema = T.StructType([T.StructField(key, row_schema[key].dataType), *CRAWL_STATE_SCHEMA.fields[1:]])
        self.stats_schema = T.StructType([T.StructField(key, row_schema[key].dataType),
                                          T.StructField("reviews", T.LongType()), T.StructField("positive", T.LongType())])

    # ------------------------------------------------------------ reading
    def version(self) -> Version:
        """The current version, for readers that open several tables of one state."""
        return self.log.current()

    def current(self, version: Version | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Reviews and state of the current (or a pinned) version; ``None`` before
        the first batch. Later batches do not change what these read."""
        version = version or self.version()
        return tuple(self.log.read(version, t, s) if version.tables.get(t) else None
                     for t, s in (("table", self.schema), ("state", self.state_schema)))

    def stats(self, version: Version | None = None) -> DataFrame:
        """``(appid, review_count, positive_ratio)`` of every item with reviews, from
        the kept sums: no review is read."""
        sums = self.log.read(version or self.version(), "stats", self.stats_schema).groupBy(self.key).agg(
            F.sum("reviews").alias("review_count"), F.sum("positive").alias("__p"))
        return sums.where(F.col("review_count") > 0).select(
            self.key, "review_count", (F.col("__p") / F.col("review_count")).alias("positive_ratio"))

    def changes(self, since: Version | None = None, version: Version | None = None) -> DataFrame:
        """The change feed of the commits after ``since`` (all by default): the key
        and the feed columns of every review, with ``op`` and ``commit``."""
        version = version or self.version()
        old = since.tables.get("changes", {}) if since else {}
        new = {c: b for c, b in version.tables.get("changes", {}).items() if c not in old}
        return self.log.read(Version(version.number, "", {"changes": new}), "changes", self.feed_schema, keep=True)

    def reviews(self, version: Version | None = None) -> DataFrame:
        """The stored reviews under the names that the summary corpus reads."""
        table = self.current(version)[0]
        if table is None:
            table = self.spark.createDataFrame([], self.schema)
        return table.withColumnRenamed("review", "review_text")

    def loaded_files(self, version: Version | None = None) -> DataFrame:
        """(path, appid, pages) of the landed files that a job has taken."""
        return self.log.read(version or self.version(), "files", FILES_SCHEMA)

    # ------------------------------------------------------------ writing
    def _key_bucket(self):
        return bucket_of(self.key, self.n_buckets)

    def _row_bucket(self):
        return bucket_of(self.key, self.n_buckets, self.keys[1], self.n_parts)

    def _positive(self, sign: int):
        if self.voted_col is None:
            return F.lit(0).cast("bigint")
        liked = F.lower(F.col(self.voted_col).cast("string")).isin("true", "1")
        return F.coalesce(liked, F.lit(False)).cast("bigint") * sign

    def apply(self, batch: DataFrame, files: DataFrame | None = None) -> Version:
        """Upsert one batch, advance the state of its keys, and keep statistics and
        change feed in step, as one version. ``files`` (path, appid, pages) are noted
        as loaded with it."""
        scratch = checkpoint_path(self.spark, f"store-batch-{uuid.uuid4().hex[:12]}")
        try:
            return self._apply(batch, files, scratch)
        finally:
            self.log.files.remove(scratch)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        """Rows that are read several times, computed once (a reliable checkpoint
        computes them twice) and stored by column: the key scans read keys only."""
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _apply(self, batch: DataFrame, files: DataFrame | None, scratch: str) -> Version:
        base = self.version()
        batch = self._written(batch, os.path.join(scratch, "batch"))
        keyed = [r[0] for r in batch.select(self._key_bucket()).distinct().collect()]   # <= n_buckets values
        commit = self.log.new_commit()
        written: dict[str, list[int] | None] = {}
        dropped: dict[str, list[int] | None] = {}
        if files is not None:
            written["files"] = self.log.write(files.select(*FILES_SCHEMA.names), "files", commit)
        if not keyed:
            return self.log.commit(base, commit, written, dropped) if written else base
        cols = [f.name for f in self.schema.fields]
        state = self.log.read(base, "state", self.state_schema, keyed)
        new = incremental_rows(batch, state, self.key, self.keys[1], self.ts_col).select(*cols)
        new = self._written(new.withColumn(BUCKET, self._row_bucket()), os.path.join(scratch, "new"))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]   # <= n_buckets * n_parts values
        if not touched:
            return self.log.commit(base, commit, written, dropped) if written else base
        ids = [*self.keys]
        old_rows = self.log.read(base, "table", self.schema, touched)
        # the replaced reviews: their keys first, then their buckets' rows
        old_keys = old_rows.select(*ids).withColumn(BUCKET, self._row_bucket())
        replaced = [r[0] for r in old_keys.join(new.select(*ids), ids, "left_semi").select(BUCKET).distinct().collect()]
        shown = self.feed_schema.names[1:]
        feed = new.select(F.lit(ADD).alias("op"), *shown)
        if replaced:
            existing = self.log.read(base, "table", self.schema, replaced)
            incoming = new.where(F.col(BUCKET).isin(replaced)).drop(BUCKET)
            self.log.write(upsert(existing, incoming, self.keys).select(*cols), "table", commit, self._row_bucket())
            feed = feed.unionByName(existing.join(incoming.select(*ids), ids, "left_semi").select(
                F.lit(RETRACT).alias("op"), *shown))
            dropped["table"] = replaced
        inserts = new.where(~F.col(BUCKET).isin(replaced)) if replaced else new
        written["table"] = self.log.write(inserts.select(*cols), "table", commit, self._row_bucket())
        written["changes"] = self.log.write(feed, "changes", commit)
        fed = self.spark.read.schema(self.feed_schema).parquet(self.log.folder("changes", commit))
        sign = F.when(F.col("op") == ADD, 1).otherwise(-1)
        sums = fed.groupBy(self.key).agg(F.sum(sign.cast("bigint")).alias("reviews"),
                                         F.sum(F.when(F.col("op") == ADD, self._positive(1)).otherwise(self._positive(-1)))
                                         .alias("positive"))
        written["stats"] = self.log.write(sums, "stats", commit)
        new_state = next_state(state, new.drop(BUCKET), self.key, self.ts_col).select(*self.state_schema.names)
        written["state"] = self.log.write(new_state, "state", commit, self._key_bucket())
        dropped["state"] = keyed
        return self.log.commit(base, commit, written, dropped)

    def compact(self, buckets: list[int] | None = None) -> Version:
        """Rewrite buckets of the reviews (all by default) into files of a good size,
        and the statistics into one row per item: same rows, fewer files."""
        base, commit = self.version(), self.log.new_commit()
        if not base.number:
            return base
        rows = self.log.read(base, "table", self.schema, buckets)
        written = {"table": self.log.write(rows, "table", commit, self._row_bucket())}
        sums = self.log.read(base, "stats", self.stats_schema).groupBy(self.key).agg(
            F.sum("reviews").alias("reviews"), F.sum("positive").alias("positive")).where(F.col("reviews") > 0)
        written["stats"] = self.log.write(sums, "stats", commit)
        return self.log.commit(base, commit, written, {"table": buckets, "stats": None})

    def vacuum(self, keep: int = 1) -> int:
        """Remove what only older versions use (see :meth:`VersionLog.vacuum`)."""
        return self.log.vacuum(keep)


def run_batch(spark: SparkSession, feed: DataFrame, store: ReviewStore) -> None:
    """Plain batch form of the ingest (same function as the stream sink)."""
    store.apply(feed)


def run_stream(spark: SparkSession, landing: str, store: ReviewStore, fmt: str = "parquet",
               checkpoint: str | None = None, max_files_per_trigger: int | None = None,
               processing_time: str | None = None, pages: bool = False, language: str | None = None):
    """Process every landed file not seen before, then stop
    (``availableNow``). Re-running picks up only newer files.

    The files hold rows of the store's schema, or with ``pages=True`` landed
    review pages (JSON), whose reviews are taken (in one ``language`` if given).

    With ``processing_time`` (e.g. ``"10 minutes"``) the query keeps running
    with that trigger and its handle is returned (``stop()`` it when done).
    """
    reader = spark.readStream.format("json" if pages else fmt).schema(PAGE_JSON_SCHEMA if pages else store.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(landing)
    ckpt = checkpoint or checkpoint_path(spark, "ingest-stream-" + os.path.basename(store.root.rstrip("/")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        if pages:
            batch = page_reviews(batch, language).select(*[F.col(f.name).cast(f.dataType) for f in store.schema.fields])
        store.apply(batch)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
    if processing_time:
        return writer.trigger(processingTime=processing_time).start()
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return None
