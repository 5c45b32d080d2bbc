"""The review watermark as keyed streaming state.

The same ingest as :func:`vitrine.streaming.ingest_stream.run_stream`, with each
item's ``last_timestamp_updated`` held by Spark's state store instead of a table:
``applyInPandasWithState`` keeps one number per item, lets through the reviews that
are newer than it was when the micro-batch began, and advances it. Rows of an item
come as a stream of Arrow batches, so a hot item's batch is never held whole.

Before that, exact repeats of a landed row are dropped by
``dropDuplicatesWithinWatermark`` on (item, review, time of update): its state is
bounded by ``delay`` of *landing* time, because review times say nothing about
arrival (an item crawled for the first time brings years of old reviews). A repeat
that lands later is at or below the item's watermark and is stopped there. An edited
review has a newer time of update and passes.

The sink upserts into a :class:`~vitrine.streaming.ingest_stream.ReviewStore`. Its
state table follows the streaming state, so a batch job can take over from the same
store; a micro-batch that is run again after a crash upserts nothing twice.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vitrine.session import checkpoint_path
from vitrine.streaming.ingest_stream import ReviewStore

DELAY = "1 hour"
STATE = "last_timestamp_updated bigint"


def _newer(ts_col: str, id_col: str):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else 0
        newest = since
        for rows in batches:
            ts = rows[ts_col].fillna(0).astype("int64")
            new = (ts > since) & rows[id_col].notna() & (rows[id_col].astype(str) != "")
            if new.any():
                newest = max(newest, int(ts[new].max()))
                yield rows[new]
        if newest > since:
            state.update((newest,))
    return run


def new_reviews(landed: DataFrame, key: str = "appid", id_col: str = "recommendationid",
                ts_col: str = "timestamp_updated", landed_col: str = "landed_at", delay: str = DELAY) -> DataFrame:
    """The reviews of a stream that are newer than their item's watermark; ``landed``
    has the time at which each row arrived in ``landed_col``."""
    once = landed.withWatermark(landed_col, delay).dropDuplicatesWithinWatermark([key, id_col, ts_col])
    rows = once.drop(landed_col)
    # nulls of integer columns survive pandas as they are nullable only on the way out
    return rows.groupBy(key).applyInPandasWithState(
        _newer(ts_col, id_col), rows.schema, STATE, "append", GroupStateTimeout.NoTimeout)


def run_keyed(spark, landing: str, store: ReviewStore, fmt: str = "parquet", checkpoint: str | None = None,
              max_files_per_trigger: int | None = None, delay: str = DELAY) -> None:
    """Process every landed file not seen before, then stop. A restart from the same
    checkpoint goes on with the watermarks it has."""
    reader = spark.readStream.format(fmt).schema(T.StructType(store.schema.fields))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    landed = reader.load(landing).withColumn("landed_at", F.col("_metadata.file_modification_time"))
    new = new_reviews(landed, store.key, store.keys[1], store.ts_col, "landed_at", delay)

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch)
    ckpt = checkpoint or checkpoint_path(spark, "keyed-stream-" + os.path.basename(store.root.rstrip("/")))
    new.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", ckpt).trigger(
        availableNow=True).start().awaitTermination()
