"""End-to-end jobs with a deterministic stand-in generator."""

import os

from pyspark.sql import functions as F

from vitrine.plans import jobs


def reviews_items(spark):
    reviews = spark.createDataFrame(
        [(1, "r1", "english", "great", 5, 1), (1, "r2", "English", "fine", 9, 2),
         (1, "r3", "german", "gut", 50, 3), (2, "r4", "english", None, 1, 1),
         (3, "r5", "english", "meh", 0, 1), (3, "r6", "english", "boom", 0, 2)],
        "appid bigint, recommendationid string, language string, review_text string, votes_up bigint, "
        "timestamp_created bigint")
    items = spark.createDataFrame([(1, "One", 3, "d1", ["A"]), (2, "Two", 1, "d2", None),
                                   (3, "Three", 2, None, ["B", "C"]), (4, "  ", 9, "d4", [])],
                                  "appid bigint, name string, review_count bigint, short_description string, "
                                  "genres array<string>")
    return reviews, items


def make_summarizer():
    def fn(prompt):
        if "Three" in prompt:
            raise RuntimeError("model failed")
        return "S:" + str(len(prompt))
    return fn


def test_summary_job_resumes(spark, tmp):
    reviews, items = reviews_items(spark)
    out = os.path.join(tmp, "summaries")
    n1 = jobs.summary_job(spark, reviews, items, out, make_summarizer, top_n=10, min_review_count=1)
    n2 = jobs.summary_job(spark, reviews, items, out, make_summarizer, top_n=10, min_review_count=1)
    got = {r.appid: (r.summary is not None, r.n_reviews_used, r.n_reviews_total)
           for r in spark.read.parquet(out).collect()}
    # item 2 has only null texts, item 4 no reviews; the failed item is stored as null
    assert (n1, n2) == (2, 0)
    assert got == {1: (True, 2, 3), 3: (False, 2, 2)}


def make_aliaser():
    def fn(prompt):
        if "Name: One" in prompt:
            return 'ok {"aliases": ["one", "The First", "FirstOne", "first"]}'
        return "no json"
    return fn


def test_alias_job(spark, tmp):
    _, items = reviews_items(spark)
    out = os.path.join(tmp, "aliases")
    assert jobs.alias_job(spark, items, out, make_aliaser, top_n=10, min_review_count=1) == 3
    got = {r.appid: (r.aliases, r.alias_text) for r in spark.read.parquet(out).collect()}
    assert got == {1: (["the first", "first"], "the first; first"), 2: ([], ""), 3: ([], "")}
    assert jobs.alias_job(spark, items, out, make_aliaser, top_n=10, min_review_count=1) == 0


def test_catalog_job(spark, tmp):
    d = tmp
    with open(os.path.join(d, "applications.csv"), "w") as f:
        f.write('appid,name,type,is_free,release_date,short_description\n'
                '10,"Portal, the game",game,false,"Apr 18, 2011","A ""puzzle""\nwith portals"\n'
                '20,Doom,game,true,Q4 2025,\n')
    with open(os.path.join(d, "application_genres.csv"), "w") as f:
        f.write("appid,genre_id\n10,1\n10,2\n10,9\n")
    with open(os.path.join(d, "genres.csv"), "w") as f:
        f.write("id,name\n1,Puzzle\n2,Action\n")
    with open(os.path.join(d, "reviews.csv"), "w") as f:
        f.write('recommendationid,appid,review_text,voted_up\nr1,10,"good\nreally",True\nr2,10,bad,false\n')
    jobs.build_catalog_job(spark, *(os.path.join(d, n) for n in
                                    ["applications.csv", "application_genres.csv", "genres.csv", "reviews.csv"]),
                           os.path.join(d, "clean"), os.path.join(d, "stats"))
    rows = {r.appid: r for r in spark.read.parquet(os.path.join(d, "stats")).collect()}
    assert rows["10"].genres == ["Action", "Puzzle"] and rows["10"].release_year == 2011
    assert rows["10"].review_count == 2 and rows["10"].positive_ratio == 0.5
    assert rows["20"].release_year is None and rows["20"].review_count is None
    assert rows["10"].name_normalized == "portal the game"
    # the same from reviews converted once to splittable files
    from vitrine.sources.csv import convert_reviews
    table = convert_reviews(spark, os.path.join(d, "reviews.csv"), os.path.join(d, "reviews"))
    jobs.build_catalog_job(spark, *(os.path.join(d, n) for n in
                                    ["applications.csv", "application_genres.csv", "genres.csv"]), table,
                           os.path.join(d, "clean2"), os.path.join(d, "stats2"))
    assert {r.appid: (r.review_count, r.positive_ratio) for r in spark.read.parquet(os.path.join(d, "stats2")).collect()} \
        == {k: (r.review_count, r.positive_ratio) for k, r in rows.items()}


def make_rewriter():
    def fn(text):
        if text == "boom":
            raise RuntimeError("model failed")
        if text == "none":
            return None
        return "Output: " + text.upper()
    return fn


def test_generate_distinct(spark):
    from vitrine.operators.enrich import generate_distinct
    df = spark.createDataFrame([(1, "cheap rpg"), (2, "cheap rpg"), (3, "boom"), (4, "none"), (5, None)],
                               "qid int, text string")
    got = {r.qid: r.rewritten for r in generate_distinct(df, make_rewriter).collect()}
    # prefix removed; failed or empty responses keep the input; null input stays null
    assert got == {1: "CHEAP RPG", 2: "CHEAP RPG", 3: "boom", 4: "none", 5: None}


def make_encoder():
    def enc(texts):
        return [[float(t.count("a")), float(t.count("b")), float(len(t) % 3)] for t in texts]
    return enc


def test_encode_unit_vectors(spark):
    import numpy as np
    from vitrine.operators.enrich import encode
    df = spark.createDataFrame([(1, "aab"), (2, ""), (3, None), (4, "bbbb")], "qid int, text string")
    got = {r.qid: r.vec for r in encode(df, make_encoder).collect()}
    assert got[1] == np.divide([2.0, 1.0, 0.0], np.sqrt(5.0)).tolist()
    assert got[2] == [0.0, 0.0, 0.0] and got[3] == [0.0, 0.0, 0.0]      # zero stays zero
    assert np.linalg.norm(got[4]) == 1.0


def test_corpus_item_copies(spark):
    from vitrine.operators.enrich import summary_corpus
    reviews, items = reviews_items(spark)
    copies = items.unionByName(items.where("appid = 1")).unionByName(items.where("appid = 1"))
    got = summary_corpus(reviews, copies, None, 10, 1).collect()
    assert sorted(r.appid for r in got) == [1, 3]
    one = {r.appid: r.corpus for r in summary_corpus(reviews, items, None, 10, 1).collect()}
    assert {r.appid: r.corpus for r in got} == one


def test_generation_is_spread(spark):
    from vitrine.operators.enrich import generate
    df = spark.range(40).select(F.col("id").cast("string").alias("prompt")).coalesce(1)
    assert generate(df, make_rewriter, tasks=5).rdd.getNumPartitions() == 5


def test_all_landed_keys_by_default(spark, tmp):
    import json
    from vitrine.schema import REVIEWS_RAW_SCHEMA
    from vitrine.streaming.ingest_stream import ReviewStore
    os.makedirs(os.path.join(tmp, "pages"))
    with open(os.path.join(tmp, "pages", "p.json"), "w") as f:
        for key in range(1, 6):
            for no in (1, 2):
                f.write(json.dumps({"appid": key, "page_no": no, "reviews": [
                    {"recommendationid": f"{key}-{no}", "timestamp_updated": 10 * no, "language": "english"}]}) + "\n")
    store = ReviewStore(spark, os.path.join(tmp, "store"), REVIEWS_RAW_SCHEMA, n_buckets=2)
    report = jobs.incremental_load_job(spark, os.path.join(tmp, "pages"), store).collect()
    assert sorted(tuple(r) for r in report) == [(k, 0, 2, 20, 2) for k in range(1, 6)]
    assert store.current()[0].count() == 10


def test_serving_table_follows_its_inputs(spark, tmp):
    """Rewritten input files give a new table, unchanged ones do not."""
    import shutil
    from vitrine.plans.bindings import SERVING_INPUTS, Tables
    for name in SERVING_INPUTS:
        shutil.copyfile(f"/root/testdata/sf0.001/{name}.parquet", f"{tmp}/{name}.parquet")
    first = Tables(spark, tmp).serving_table()
    assert Tables(spark, tmp).serving_table().inputFiles() == first.inputFiles()
    n = first.count()
    less = spark.read.parquet(f"{tmp}/embeddings.parquet").where("vec_id % 2 = 0").toPandas()
    less.to_parquet(f"{tmp}/embeddings.parquet")
    assert 0 < Tables(spark, tmp).serving_table().count() < n


def test_corpus_reports_cuts(spark):
    from vitrine.operators.enrich import summary_corpus
    reviews, items = reviews_items(spark)
    got = lambda *a: {r.appid: (r.corpus, r.n_chars_total, r.truncated)
                      for r in summary_corpus(reviews, items, None, 10, 1, *a).collect()}
    assert got(80, 6) == {1: ("fine\n\n", 11, True), 3: ("boom\n\n", 9, True)}
    assert got(None, None) == {1: ("fine\n\ngreat", 11, False), 3: ("boom\n\nmeh", 9, False)}
    assert got(1, None) == {1: ("fine", 4, False), 3: ("boom", 4, False)}
