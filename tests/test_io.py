"""Sources, table definitions, page JSON and schema gates on small files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.text import split_list
from vitrine.schema import (CRAWL_STATE_SCHEMA, canonical_key, require_columns,
                            with_canonical_key)
from vitrine.sources import binary, csv, pages, parquet, records


def test_embedding_map_and_build(spark, tmp):
    mp = os.path.join(tmp, "map.csv")
    with open(mp, "w") as f:
        f.write("appid,vector_index\n620,1\n440,0\n570,x\n")
    m = {r.appid: r.vector_index for r in csv.read_embedding_map(spark, mp).collect()}
    assert m == {"620": 1, "440": 0, "570": None}          # bad index -> null
    vp = os.path.join(tmp, "v.raw")
    np.arange(8, dtype="<f4").reshape(2, 4).tofile(vp)
    out = os.path.join(tmp, "emb.parquet")
    binary.build_embeddings_table(spark, vp, mp, out, dim=4)
    got = {r.appid: r.embedding for r in spark.read.parquet(out).collect()}
    assert got == {"620": [4.0, 5.0, 6.0, 7.0], "440": [0.0, 1.0, 2.0, 3.0]}


def test_check_dims(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    binary.check_dims(df.limit(1), 2)
    with pytest.raises(ValueError):
        binary.check_dims(df, 2)


def test_create_table_if_absent(spark, tmp):
    loc = os.path.join(tmp, "crawl_state")
    parquet.create_table_if_absent(spark, "crawl_state_t", CRAWL_STATE_SCHEMA, loc)
    parquet.create_table_if_absent(spark, "crawl_state_t", CRAWL_STATE_SCHEMA, loc)   # idempotent
    cols = [f.name for f in spark.table("crawl_state_t").schema.fields]
    assert cols == ["appid", "last_timestamp_updated", "last_run_at"]
    assert spark.table("crawl_state_t").count() == 0
    spark.sql("DROP TABLE crawl_state_t")


def _page(appid, page_no, cursor, reviews, total):
    return {"appid": appid, "page_no": page_no, "cursor": cursor, "reviews": reviews,
            "query_summary": {"total_reviews": total}}


def _review(rid, lang, ts, voted_up=True, score="0.5"):
    return {"recommendationid": rid, "language": lang, "review": f"text {rid}", "voted_up": voted_up,
            "votes_up": 3, "votes_funny": 0, "weighted_vote_score": score, "timestamp_created": ts,
            "timestamp_updated": ts, "steam_purchase": None, "received_for_free": False,
            "written_during_early_access": True,
            "author": {"steamid": "s" + rid, "playtime_forever": 10}}


def test_page_sources(spark, tmp):
    p = os.path.join(tmp, "pages")
    os.makedirs(p)
    rows = [_page(620, 1, "c1", [_review("1", "english", 30), _review("2", "German", 20, None, "")], 3),
            _page(620, 2, "c2", [_review("3", "English", 10, False)], 3),
            _page(440, 1, None, [], 0)]
    with open(os.path.join(p, "part-0.json"), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    pg = pages.read_pages(spark, p)
    got = {r.recommendationid: r for r in pages.page_reviews(pg).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["2"].voted_up is None and got["2"].weighted_vote_score is None   # null kept, "" -> null
    assert got["3"].voted_up == 0 and got["1"].steam_purchase is None
    assert got["1"].author_steamid == "s1" and got["1"].written_during_early_access == 1
    assert {r.recommendationid for r in pages.page_reviews(pg, "english").collect()} == {"1", "3"}
    summ = {(r.appid, r.page_no): (r.n_reviews, r.cursor, r.total_reviews)
            for r in pages.page_summary(pg).collect()}
    assert summ == {(620, 1): (2, "c1", 3), (620, 2): (1, "c2", 3), (440, 1): (0, None, 0)}


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "a")], "appid bigint, name string")
    require_columns(df, ["appid", "name"])
    with pytest.raises(ValueError, match="summary"):
        require_columns(df, ["appid", "summary"], "summaries")


def test_split_list(spark):
    df = spark.createDataFrame([(" Action, RPG ,,\tIndie ",), ("",), (None,)], "g string")
    got = [r.x for r in df.select(split_list("g").alias("x")).collect()]
    assert got == [["Action", "RPG", "Indie"], [], None]


def test_canonical_key(spark):
    df = spark.createDataFrame([("620",), (" 440 ",), ("570.0",), ("x",), (None,)], "appid string")
    assert [r.k for r in df.select(canonical_key("appid").alias("k")).collect()] == [620, 440, 570, None, None]
    assert [r.appid for r in with_canonical_key(df).collect()] == [620, 440, 570]


def test_write_json(spark, tmp):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "d")],
                               "appid bigint, r double, short_description string")
    out = os.path.join(tmp, "recs.json")
    records.write_json(df, out)
    got = {r.appid: (r.r, r.short_description) for r in spark.read.json(out).collect()}
    assert got == {1: (None, ""), 2: (0.5, "d")}
    lines = [json.loads(r.value) for r in records.to_json_lines(df).orderBy(F.col("value")).collect()]
    assert lines[0]["appid"] == 1 and "r" not in lines[0]


def test_incremental_load_job(spark, tmp):
    from vitrine.plans.jobs import incremental_load_job
    from vitrine.schema import REVIEWS_RAW_SCHEMA
    from vitrine.streaming.ingest_stream import ReviewStore
    p = os.path.join(tmp, "pages")
    os.makedirs(p)
    rows = [_page(620, 1, "c1", [_review("1", "english", 30), _review("2", "german", 20)], 3),
            _page(620, 2, "c2", [_review("3", "english", 10)], 3),
            _page(999, 1, "c9", [_review("9", "english", 5)], 1)]     # not a picked key
    with open(os.path.join(p, "day1.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    store = ReviewStore(spark, os.path.join(tmp, "store"), REVIEWS_RAW_SCHEMA, n_buckets=4)
    rep = {r.appid: (r.since, r.fetched, r.newest) for r in incremental_load_job(spark, p, store, k=3).collect()}
    assert rep == {620: (0, 3, 30), 440: (0, 0, 0), 570: (0, 0, 0)}      # default keys, no catalog
    table, state = store.current()
    assert sorted(r.recommendationid for r in table.collect()) == ["1", "2", "3"]
    # next day: one newer review and one repeated page
    with open(os.path.join(p, "day2.json"), "w") as f:
        f.write(json.dumps(_page(620, 1, "c1", [_review("4", "english", 40), _review("1", "english", 30)], 4)) + "\n")
    rep = {r.appid: (r.since, r.fetched, r.newest) for r in incremental_load_job(spark, p, store, k=3).collect()}
    assert rep[620] == (30, 1, 40)
    assert store.current()[0].count() == 4
