"""Versioned store: pinned readers, crashes, change feed and kept statistics."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators.catalog import review_stats
from vitrine.plans import jobs
from vitrine.schema import REVIEWS_RAW_SCHEMA
from vitrine.sources import versions
from vitrine.streaming.ingest_stream import ReviewStore

FEED = "appid bigint, recommendationid string, timestamp_updated bigint, voted_up string, review string"


def store_of(spark, tmp, **kw):
    return ReviewStore(spark, os.path.join(tmp, "store"), spark.createDataFrame([], FEED).schema,
                       **{"n_buckets": 4, "n_parts": 2, **kw})


def batch(spark, rows):
    return spark.createDataFrame(rows, FEED)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_reader_keeps_its_version(spark, tmp):
    store = store_of(spark, tmp)
    store.apply(batch(spark, [(k, f"r{k}", 10, "true", "old") for k in range(20)]))
    pinned = store.version()
    table, state = store.current()
    before, marks = rows_of(table), rows_of(state)
    store.apply(batch(spark, [(k, f"r{k}", 20, "false", "new") for k in range(10)]))
    store.compact()
    # opened before: the old rows to the end; a pinned version can be opened again
    assert rows_of(table) == before == rows_of(store.current(pinned)[0]) and rows_of(state) == marks
    assert {r[4] for r in rows_of(store.current()[0]) if r[0] < 10} == {"new"}
    assert [v.number for v in store.log.versions()] == [3, 2, 1]
    assert store.vacuum(keep=1) > 0
    assert [v.number for v in store.log.versions()] == [3]
    assert len(rows_of(store.current()[0])) == 20 and store.vacuum() == 0


def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp, monkeypatch):
    store = store_of(spark, tmp)
    store.apply(batch(spark, [(1, "a", 10, "true", "x"), (2, "b", 10, "true", "x")]))
    old = rows_of(store.current()[0]), rows_of(store.current()[1]), rows_of(store.stats())
    new = batch(spark, [(1, "a", 20, "false", "y"), (3, "c", 20, "true", "y")])

    def crash(*args):
        raise SystemExit("lost")
    for name in ("swap", "write"):  # before the pointer moves, and before the manifest is written
        with monkeypatch.context() as m:
            m.setattr(versions.Files, name, crash)
            with pytest.raises(SystemExit):
                store.apply(new)
        assert (rows_of(store.current()[0]), rows_of(store.current()[1]), rows_of(store.stats())) == old
    store.apply(new)
    assert [r[:3] for r in rows_of(store.current()[0])] == [(1, "a", 20), (2, "b", 10), (3, "c", 20)]
    assert [(r.appid, r.last_timestamp_updated) for r in store.current()[1].orderBy("appid").collect()] == [
        (1, 20), (2, 10), (3, 20)]
    assert store.vacuum() > 0 and len(rows_of(store.current()[0])) == 3


def test_a_second_writer_is_refused(spark, tmp):
    store = store_of(spark, tmp)
    first = store.apply(batch(spark, [(1, "a", 10, "true", "x")]))
    store.apply(batch(spark, [(1, "b", 20, "true", "x")]))
    with pytest.raises(versions.StaleVersion):
        store.log.commit(first, store.log.new_commit(), {})


def test_statistics_follow_the_upserts(spark, tmp):
    rng = random.Random(5)
    store = store_of(spark, tmp)
    for ts in range(1, 5):
        rows = [(rng.choice([7, 7, 7, *range(12)]), f"r{rng.randrange(60)}", ts, rng.choice(["true", "False", None]), "t")
                for _ in range(120)]
        before = store.version()
        store.apply(batch(spark, rows))
        store.apply(batch(spark, rows))  # the same batch again changes nothing
        table = store.current()[0]
        want = {r.appid: (r.review_count, r.positive_ratio) for r in review_stats(table).collect()}
        assert {r.appid: (r.review_count, pytest.approx(r.positive_ratio)) for r in store.stats().collect()} == want
        # the feed of this batch: every key it added or replaced, once each way
        feed = store.changes(since=before)
        adds = feed.where("op = 'add'")
        assert adds.select("appid", "recommendationid").distinct().count() == adds.count()
        touched = {r.appid for r in feed.select("appid").distinct().collect()}
        commit = next(iter(store.version().tables["stats"].keys() - before.tables.get("stats", {}).keys()))
        written = spark.read.parquet(store.log.folder("stats", commit))
        assert {r.appid for r in written.collect()} == touched and written.count() == len(touched)
    assert store.changes().where("op = 'retract'").count() > 0
    total = rows_of(store.stats())
    store.compact()
    assert rows_of(store.stats()) == total
    assert store.spark.read.parquet(*[store.log.folder("stats", c) for c in store.version().tables["stats"]]).count() == len(total)


def test_the_corpus_reads_the_store(spark, tmp):
    from vitrine.operators.enrich import summary_corpus
    store = ReviewStore(spark, os.path.join(tmp, "store"), REVIEWS_RAW_SCHEMA, n_buckets=2)
    assert store.reviews().count() == 0
    row = {f.name: None for f in REVIEWS_RAW_SCHEMA.fields}
    rows = [{**row, "appid": 1, "recommendationid": str(k), "language": "english", "review": f"text {k}", "voted_up": k % 2,
             "votes_up": k, "timestamp_updated": 5, "timestamp_created": 1} for k in range(3)]
    store.apply(spark.createDataFrame(rows, REVIEWS_RAW_SCHEMA))
    items = store.stats().withColumn("name", F.lit("One"))
    got = summary_corpus(store.reviews(), items, None, 10, 1).collect()
    assert [(r.corpus, r.n_reviews_total) for r in got] == [("text 2\n\ntext 1\n\ntext 0", 3)]
    assert [tuple(r) for r in store.stats().collect()] == [(1, 3, pytest.approx(1 / 3))]


def test_a_page_is_read_once(spark, tmp):
    import json
    store = ReviewStore(spark, os.path.join(tmp, "store"), REVIEWS_RAW_SCHEMA, n_buckets=2)
    landing = os.path.join(tmp, "pages")
    os.makedirs(landing)

    def land(name, key, no, ids):
        with open(os.path.join(landing, name), "w") as f:
            f.write(json.dumps({"appid": key, "page_no": no, "reviews": [
                {"recommendationid": i, "timestamp_updated": 10 * no, "language": "english"} for i in ids]}) + "\n")

    def run():
        return sorted(tuple(r) for r in jobs.incremental_load_job(spark, landing, store).collect())
    land("a.json", 1, 1, ["x", "y"])
    land("b.json", 2, 1, ["z"])
    land("c.json", None, 9, [])
    assert run() == [(1, 0, 2, 10, 1), (2, 0, 1, 10, 1)]
    seen = store.version()
    # nothing new: no page is read, the version stays
    assert run() == [(1, 10, 0, 10, 1), (2, 10, 0, 10, 1)] and store.version() == seen
    land("d.json", 2, 2, ["w"])
    assert run() == [(1, 10, 0, 10, 1), (2, 10, 1, 20, 2)]
    assert store.current()[0].count() == 4
    land("a.json", 1, 3, ["x"])  # a file that was written anew is a new file
    assert run() == [(1, 10, 1, 30, 2), (2, 20, 0, 20, 2)]
    assert {r.timestamp_updated for r in store.current()[0].where("recommendationid = 'x'").collect()} == {30}


def test_a_batch_is_computed_once(spark, tmp):
    """The rows of a batch are worked out once, and nothing of them stays behind."""
    from vitrine.session import ensure_checkpoint_dir
    store = store_of(spark, tmp)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = batch(spark, [(k, f"r{k}", 10, "true", "x") for k in range(40)]).mapInArrow(count, FEED)
    store.apply(rows)
    assert seen.value == 40 and store.current()[0].count() == 40
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert not [n for n in os.listdir(folder) if n.startswith("store-batch-")]
