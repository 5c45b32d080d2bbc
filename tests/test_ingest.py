"""Incremental ingest: watermark, dedup, upsert idempotence, state, stop
rule against a simulation of the page loop, streaming versus batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import ingest

FEED_SCHEMA = "appid bigint, recommendationid string, timestamp_updated bigint, review string"


def feed_rows():
    return [(1, "a", 100, "x"), (1, "b", 200, "y"), (1, "b", 150, "old b"), (1, "", 300, "no id"),
            (1, None, 300, "no id"), (2, "c", None, "no ts"), (2, "d", 50, "z"), (3, "e", 10, "w")]


def test_incremental_and_state(spark):
    feed = spark.createDataFrame(feed_rows(), FEED_SCHEMA)
    state = spark.createDataFrame([(1, 120, None), (2, 0, None)],
                                  "appid bigint, last_timestamp_updated bigint, last_run_at timestamp")
    new = ingest.incremental_rows(feed, state)
    got = sorted((r.appid, r.recommendationid, r.timestamp_updated) for r in new.collect())
    assert got == [(1, "b", 200), (2, "d", 50), (3, "e", 10)]
    st = {r.appid: r.last_timestamp_updated for r in ingest.next_state(state, new).collect()}
    assert st == {1: 200, 2: 50, 3: 10}


def ingest_step(feed, table, state):
    new = ingest.incremental_rows(feed, state).drop("since")
    return new, ingest.upsert(table, new, ("appid", "recommendationid")), ingest.next_state(state, new)


def test_upsert_idempotent_and_halves(spark):
    feed = spark.createDataFrame(feed_rows(), FEED_SCHEMA)
    _, t1, s1 = ingest_step(feed, None, None)
    _, t2, s2 = ingest_step(feed, t1, s1)      # same batch again
    key = lambda df: sorted(tuple(r) for r in df.select("appid", "recommendationid", "timestamp_updated").collect())
    assert key(t1) == key(t2)
    half1 = feed.where("timestamp_updated < 120 OR timestamp_updated IS NULL")
    half2 = feed.where("timestamp_updated >= 120")
    _, a, sa = ingest_step(half1, None, None)
    _, b, sb = ingest_step(half2, a, sa)
    assert key(b) == key(t1)
    assert sorted(tuple(r) for r in sb.select("appid", "last_timestamp_updated").collect()) == \
        sorted(tuple(r) for r in s1.select("appid", "last_timestamp_updated").collect())


def test_upsert_replaces(spark):
    old = spark.createDataFrame([(1, "a", 1, "v1"), (1, "b", 1, "keep")], FEED_SCHEMA)
    new = spark.createDataFrame([(1, "a", 2, "v2")], FEED_SCHEMA)
    got = {r.recommendationid: r.review for r in ingest.upsert(old, new, ["appid", "recommendationid"]).collect()}
    assert got == {"a": "v2", "b": "keep"}


def simulate(rows, since, page_size, max_pages):
    """The page loop: newest first, stop at the page with old data, on an
    empty page, or at the page cap."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    pages = [rows[i:i + page_size] for i in range(0, len(rows), page_size)] + [[]]
    fetched, seen, n_pages, stopped = 0, set(), 0, "max_pages_reached"
    for p in range(max_pages):
        n_pages = p + 1
        page = pages[p] if p < len(pages) else []
        if not page:
            stopped = "empty_reviews"
            break
        saw_old = False
        for rid, ts in page:
            if rid in seen:
                continue
            seen.add(rid)
            if ts <= since:
                saw_old = True
                continue
            fetched += 1
        if saw_old:
            stopped = "hit_old_data"
            break
    return n_pages, stopped, fetched


@pytest.mark.parametrize("page_size,max_pages", [(3, 50), (4, 2), (5, 50)])
def test_stop_rule_matches_simulation(spark, page_size, max_pages):
    rnd = random.Random(7)
    rows, state = [], []
    for key in range(1, 13):
        n = rnd.choice([0, 1, 3, 4, 5, 9, 12, 17])
        ts = rnd.sample(range(1, 1000), n)
        rows += [(key, f"{key}-{i}", t) for i, t in enumerate(ts)]
        if key % 3:
            state.append((key, rnd.choice([0, 200, 500, 990]), None))
    feed = spark.createDataFrame([(k, r, t, "") for k, r, t in rows] or [], FEED_SCHEMA)
    st = spark.createDataFrame(state, "appid bigint, last_timestamp_updated bigint, last_run_at timestamp")
    got = {r.appid: (r.pages, r.stopped, r.fetched)
           for r in ingest.stop_rule(feed, st, page_size=page_size, max_pages=max_pages).collect()}
    wm = {k: w for k, w, _ in state}
    for key in {k for k, _, _ in rows}:
        mine = [(r, t) for k, r, t in rows if k == key]
        assert got[key] == simulate(mine, wm.get(key, 0), page_size, max_pages), key


def test_stream_equals_batch(spark, tmp):
    from vitrine.streaming.ingest_stream import ReviewStore, run_batch, run_stream
    schema = spark.createDataFrame([], FEED_SCHEMA).schema
    landing = os.path.join(tmp, "landing")
    rows = feed_rows()
    spark.createDataFrame(rows[:4], FEED_SCHEMA).write.parquet(os.path.join(landing, "f1"))
    spark.createDataFrame(rows[4:], FEED_SCHEMA).write.parquet(os.path.join(landing, "f2"))
    s_store = ReviewStore(spark, os.path.join(tmp, "stream_store"), schema, n_buckets=4)
    run_stream(spark, landing + "/*", s_store, checkpoint=os.path.join(tmp, "ckpt"))
    run_stream(spark, landing + "/*", s_store, checkpoint=os.path.join(tmp, "ckpt"))   # nothing new
    b_store = ReviewStore(spark, os.path.join(tmp, "batch_store"), schema, n_buckets=4)
    run_batch(spark, spark.createDataFrame(rows, FEED_SCHEMA), b_store)
    run_batch(spark, spark.createDataFrame(rows, FEED_SCHEMA), b_store)     # idempotent
    st, sst = s_store.current()
    bt, bst = b_store.current()
    rows_of = lambda df: sorted(tuple(r) for r in df.select("appid", "recommendationid", "timestamp_updated").collect())
    assert rows_of(st) == rows_of(bt)
    assert sorted(tuple(r) for r in sst.select("appid", "last_timestamp_updated").collect()) == \
        sorted(tuple(r) for r in bst.select("appid", "last_timestamp_updated").collect())


def test_flatten_review_json(spark):
    js = ('{"recommendationid": "7", "voted_up": true, "weighted_vote_score": "", "steam_purchase": null, '
          '"author": {"steamid": "42", "playtime_forever": 5}}')
    df = spark.createDataFrame([(js,)], "j string")
    r = df.select(ingest.parse_review_json("j").alias("r")).select(*ingest.flatten_review("r")).first()
    assert (r.recommendationid, r.voted_up, r.weighted_vote_score, r.steam_purchase, r.author_steamid,
            r.playtime_forever) == ("7", 1, None, None, "42", 5)


def test_pick_keys(spark):
    items = spark.createDataFrame([(1, 5), (2, None), (3, 9), (None, 100)], "appid bigint, review_count bigint")
    assert [r.appid for r in ingest.pick_keys(items, 2).collect()] == [3, 1]
    assert [r.appid for r in ingest.default_keys(spark, 5).collect()] == [620, 440, 570]


def test_store_appends_inserts_rewrites_replaced(spark, tmp):
    from vitrine.streaming.ingest_stream import ReviewStore, run_batch
    schema = spark.createDataFrame([], FEED_SCHEMA).schema
    store = ReviewStore(spark, os.path.join(tmp, "store"), schema, n_buckets=8, n_parts=1)
    first = [(k, f"r{k}", 100, "v1") for k in range(1, 9)]
    run_batch(spark, spark.createDataFrame(first, FEED_SCHEMA), store)
    files = lambda: set(store.current()[0].inputFiles())
    before = files()
    # only new keys: every existing file stays, new files are added
    run_batch(spark, spark.createDataFrame([(k, f"n{k}", 200, "new") for k in range(1, 9)], FEED_SCHEMA), store)
    after = files()
    assert before <= after and len(after) > len(before)
    # a changed review replaces the stored one (newer than the key's watermark)
    run_batch(spark, spark.createDataFrame([(3, "r3", 300, "edited"), (9, "r9", 300, "v1")], FEED_SCHEMA), store)
    table, state = store.current()
    got = {(r.appid, r.recommendationid): (r.timestamp_updated, r.review) for r in table.collect()}
    assert len(got) == table.count() == 17                      # no duplicate keys
    assert got[(3, "r3")] == (300, "edited") and got[(1, "r1")] == (100, "v1")
    assert {r.appid: r.last_timestamp_updated for r in state.collect()}[3] == 300
    store.compact()
    assert len(files()) <= 8
    assert {(r.appid, r.recommendationid): (r.timestamp_updated, r.review)
            for r in store.current()[0].collect()} == got


def test_stream_keeps_running(spark, tmp):
    from vitrine.streaming.ingest_stream import ReviewStore, run_stream
    schema = spark.createDataFrame([], FEED_SCHEMA).schema
    landing = os.path.join(tmp, "landing")
    rows = feed_rows()
    spark.createDataFrame(rows[:4], FEED_SCHEMA).write.parquet(os.path.join(landing, "f1"))
    store = ReviewStore(spark, os.path.join(tmp, "store"), schema, n_buckets=4)
    q = run_stream(spark, landing + "/*", store, checkpoint=os.path.join(tmp, "ckpt"), processing_time="1 second")
    try:
        q.processAllAvailable()
        n1 = store.current()[0].count()
        spark.createDataFrame(rows[4:], FEED_SCHEMA).write.parquet(os.path.join(landing, "f2"))
        q.processAllAvailable()
        n2 = store.current()[0].count()
    finally:
        q.stop()
    assert n1 == 2 and n2 == 4     # (1,a), (1,b); then (2,d), (3,e)


def test_hot_key_is_spread(spark, tmp):
    """One item's reviews go to several buckets; a small update rewrites few."""
    from vitrine.streaming.ingest_stream import ReviewStore, run_batch
    schema = spark.createDataFrame([], FEED_SCHEMA).schema
    store = ReviewStore(spark, os.path.join(tmp, "store"), schema, n_buckets=4, n_parts=16)
    run_batch(spark, spark.createDataFrame([(7, f"r{k}", 100, "v1") for k in range(400)], FEED_SCHEMA), store)
    files = lambda: set(store.current()[0].inputFiles())
    before = files()
    assert len({os.path.dirname(f) for f in before}) == 16
    run_batch(spark, spark.createDataFrame([(7, "r3", 200, "v2")], FEED_SCHEMA), store)
    assert len(before - files()) == 1
    got = {r.recommendationid: r.review for r in store.current()[0].collect()}
    assert len(got) == 400 and got["r3"] == "v2"


def test_pages_as_a_stream(spark, tmp):
    """Only new page files are read."""
    import json
    from vitrine.streaming.ingest_stream import ReviewStore, run_stream
    schema = spark.createDataFrame([], FEED_SCHEMA).schema
    landing = os.path.join(tmp, "pages")
    os.makedirs(landing)

    def land(name, no, ids, ts):
        page = {"appid": 7, "page_no": no, "reviews": [
            {"recommendationid": i, "timestamp_updated": ts, "review": "t", "language": "english"} for i in ids]}
        with open(os.path.join(landing, name), "w") as f:
            f.write(json.dumps(page) + "\n")
    store = ReviewStore(spark, os.path.join(tmp, "store"), schema, n_buckets=2)
    land("a.json", 1, ["1", "2"], 10)
    run_stream(spark, landing, store, checkpoint=os.path.join(tmp, "ck"), pages=True)
    land("b.json", 2, ["3"], 20)
    run_stream(spark, landing, store, checkpoint=os.path.join(tmp, "ck"), pages=True)
    table, state = store.current()
    assert sorted(r.recommendationid for r in table.collect()) == ["1", "2", "3"]
    assert [r.last_timestamp_updated for r in state.collect()] == [20]
