"""Generation that survives a crash, the prompt memo, the keyed stream."""

import os
import uuid
from datetime import datetime, timedelta, timezone

import pytest

from vitrine.plans.memo import PromptMemo
from vitrine.schema import SUMMARIES_SCHEMA
from vitrine.sources.parquet import append_in_chunks
from vitrine.streaming.ingest_stream import ReviewStore, run_batch
from vitrine.streaming.keyed_state import run_keyed


def counting(folder, die_at=None):
    """A generator that notes every call as a file; it may take its worker with it."""
    def make():
        def fn(text):
            if die_at is not None and len(os.listdir(folder)) >= die_at:
                raise SystemExit("lost")
            open(os.path.join(folder, f"{text}-{uuid.uuid4().hex}"), "w").close()
            return None if text == "none" else "Output: " + text.upper()
        return fn
    return make


def calls(folder):
    return sorted(f.rsplit("-", 1)[0] for f in os.listdir(folder))


def test_a_crash_keeps_the_finished_chunks(spark, tmp):
    from pyspark.sql import functions as F
    from vitrine.operators.enrich import generate, with_timestamp
    folder, out = os.path.join(tmp, "calls"), os.path.join(tmp, "out")
    os.makedirs(folder)
    inputs = spark.range(40).select(F.col("id").alias("appid"), F.concat(F.lit("t"), "id").alias("prompt"))

    def work(make):
        def rows(chunk):
            gen = generate(chunk, make, "prompt", "summary", tasks=1)
            return with_timestamp(gen.select("appid", F.lit("n").alias("name"), "summary",
                                             *[F.lit(1).cast("bigint").alias(c) for c in ("n_reviews_used", "n_reviews_total")]))
        return rows
    # 4 chunks; the worker dies within the third
    sizes = [r["count"] for r in inputs.groupBy(F.pmod(F.xxhash64("appid"), F.lit(4)).alias("c")).count().orderBy("c").collect()]
    with pytest.raises(Exception):
        append_in_chunks(spark, inputs, work(counting(folder, sizes[0] + sizes[1] + 1)), out, "appid", SUMMARIES_SCHEMA, 10)
    kept = {r.appid for r in spark.read.parquet(out).collect()}
    assert len(kept) == sizes[0] + sizes[1]
    before = set(calls(folder))
    assert {f"t{k}" for k in kept} <= before and len(before) == len(kept) + 1
    for f in os.listdir(folder):
        if int(f.rsplit("-", 1)[0][1:]) not in kept:
            os.remove(os.path.join(folder, f))  # the call of the lost chunk
    n = append_in_chunks(spark, inputs, work(counting(folder)), out, "appid", SUMMARIES_SCHEMA, 10)
    assert n == 40 - len(kept)
    assert calls(folder) == sorted(f"t{k}" for k in range(40))  # no call of a kept chunk again
    rows = spark.read.parquet(out).collect()
    assert sorted(r.appid for r in rows) == list(range(40))
    assert append_in_chunks(spark, inputs, work(counting(folder)), out, "appid", SUMMARIES_SCHEMA, 10) == 0


def test_the_memo_outlives_a_call(spark, tmp):
    folder = os.path.join(tmp, "calls")
    os.makedirs(folder)
    rows = [(1, "cheap rpg"), (2, "cheap rpg"), (3, "none"), (4, None), (5, "space sim")]
    df = spark.createDataFrame(rows, "qid int, text string")
    want = {1: "CHEAP RPG", 2: "CHEAP RPG", 3: "none", 4: None, 5: "SPACE SIM"}
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    memo = PromptMemo(spark, os.path.join(tmp, "memo"), max_age_days=30)
    got = memo.rewrite(df, counting(folder), now=start)
    assert got.columns == ["qid", "text", "rewritten"]
    assert {r.qid: r.rewritten for r in got.collect()} == want
    assert calls(folder) == ["cheap rpg", "none", "space sim"]
    # another object over the same folder: only the failed text is tried again
    again = PromptMemo(spark, os.path.join(tmp, "memo"), max_age_days=30)
    late = start + timedelta(days=20)
    assert {r.qid: r.rewritten for r in again.rewrite(df.where("qid < 4"), counting(folder), now=late).collect()} == {
        k: want[k] for k in (1, 2, 3)}
    assert calls(folder) == ["cheap rpg", "none", "none", "space sim"]
    # 40 days on: what was asked for on day 20 is still there, the other has aged
    aged = start + timedelta(days=40)
    assert again.evict(now=aged) == 1
    assert {r.text for r in again._live(aged).collect()} == {"cheap rpg"}
    assert {r.qid: r.rewritten for r in again.rewrite(df, counting(folder), now=aged).collect()} == want
    assert calls(folder).count("space sim") == 2 and calls(folder).count("cheap rpg") == 1
    assert again.rewrite(df.limit(0), counting(folder), now=aged).count() == 0


FEED = "appid bigint, recommendationid string, timestamp_updated bigint, review string"


def test_keyed_stream_equals_the_batch_form(spark, tmp):
    landing = os.path.join(tmp, "landing")
    parts = [
        [(1, "a", 10, "v1"), (1, "b", 20, "v1"), (2, "c", 5, "v1"), (1, "a", 10, "v1"), (3, None, 9, "no id")],
        [(1, "a", 30, "v2"), (1, "d", 15, "late"), (2, "e", 6, "v1"), (2, "c", 5, "v1"), (4, "f", None, "no time")],
        [(2, "g", 2, "late"), (1, "h", 31, "v1"), (5, "", 9, "blank id"), (6, "z", 1, "old but new item")],
    ]
    schema = spark.createDataFrame([], FEED).schema
    stream = ReviewStore(spark, os.path.join(tmp, "stream"), schema, n_buckets=4)
    plain = ReviewStore(spark, os.path.join(tmp, "batch"), schema, n_buckets=4)
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(os.path.join(landing, f"f{k}"))
        # restarted from its checkpoint for every file, and once more with nothing new
        run_keyed(spark, landing + "/*", stream, checkpoint=os.path.join(tmp, "ckpt"))
        run_keyed(spark, landing + "/*", stream, checkpoint=os.path.join(tmp, "ckpt"))
        run_batch(spark, spark.createDataFrame(rows, FEED), plain)
        for a, b, columns in zip(stream.current(), plain.current(), (schema.names, ["appid", "last_timestamp_updated"])):
            of = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
            assert of(a) == of(b)
    got = {(r.appid, r.recommendationid): r.review for r in stream.current()[0].collect()}
    assert got == {(1, "a"): "v2", (1, "b"): "v1", (2, "c"): "v1", (2, "e"): "v1", (1, "h"): "v1", (6, "z"): "old but new item"}
