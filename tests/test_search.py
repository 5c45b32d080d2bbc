"""Name search and prompt resolution."""

from vitrine.functions.text import clean_lower, normalize_name
from pyspark.sql import functions as F

from vitrine.operators.search import find_by_name, find_by_name_batch, resolve_prompts, summary_lookup


def items(spark):
    rows = [(1, "Portal 2", "game", 100, "p2; portal coop"),
            (2, "Portal", "game", 50, None),
            (3, "Portal 2 - Soundtrack", "music", 500, None),
            (4, "Half-Life", "game", 10, "hl"),
            (5, "Stardew Valley", "game", None, None),
            (6, "Portal", "game", 50, None)]
    df = spark.createDataFrame(rows, "appid bigint, name string, type string, review_count bigint, alias_text string")
    return (df.withColumn("name_normalized", normalize_name("name"))
            .withColumn("alias_text_normalized", clean_lower("alias_text")))


def test_substring_ranking(spark):
    r = [x.appid for x in find_by_name(items(spark), "  PORTAL ", 5).collect()]
    # exact normalised match first, games before music, more reviews, shorter, key
    assert r == [2, 6, 1, 3]


def test_alias_and_literal(spark):
    assert [x.appid for x in find_by_name(items(spark), "hl", 5).collect()] == [4]
    assert find_by_name(items(spark), "half-life", 5).first().appid == 4


def test_fuzzy_fallback(spark):
    # all six rows make the max(10k, 50) shortlist; the ratio is then dropped
    # and the usual ranking (type, reviews, length, key) orders them
    r = find_by_name(items(spark), "stardw valey", 2).collect()
    assert [x.appid for x in r] == [1, 2] and {x.match_stage for x in r} == {"fuzzy"}


def test_fuzzy_shortlist_cut(spark):
    from vitrine.operators.search import fuzzy_shortlist
    many = items(spark).unionByName(
        spark.range(100, 200).select(F.col("id").alias("appid"), F.lit("zzzz qqqq").alias("name"),
                                     F.lit("game").alias("type"), F.lit(1).cast("bigint").alias("review_count"),
                                     F.lit(None).cast("string").alias("alias_text"),
                                     F.lit("zzzz qqqq").alias("name_normalized"),
                                     F.lit("").alias("alias_text_normalized")))
    got = {r.appid for r in fuzzy_shortlist(many, "stardw valey", 1).collect()}
    assert len(got) == 50 and 5 in got


def test_blank(spark):
    assert find_by_name(items(spark), "   ", 5).count() == 0


def test_resolve_prompts(spark):
    q = spark.createDataFrame([(1, "4"), (2, "portal"), (3, "a calm farm game"), (4, "  "), (5, "999")],
                              "qid int, text string")
    got = {r.qid: (r.mode, r.center_appid) for r in resolve_prompts(q, items(spark)).collect()}
    assert got == {1: ("appid", 4), 2: ("name", 2), 3: ("semantic", None), 4: ("error", None),
                   5: ("semantic", None)}


def test_summary_lookup(spark):
    s = spark.createDataFrame([(10, "Portal", "s1", 80, 100), (11, "Portal 2", "s2", None, 5),
                               (12, "Doom", "s3", 10, None)],
                              "appid bigint, name string, summary string, n_reviews_used bigint, n_reviews_total bigint")
    assert summary_lookup(s, "12").first().summary == "s3"
    assert summary_lookup(s, "portal").first().appid == 10
    r = summary_lookup(s, "99").collect()
    assert r == []
    # two parameters: the id wins; an unknown id falls back to the name
    assert summary_lookup(s, "12", name="portal").first().appid == 12
    assert summary_lookup(s, "99", name="PORTAL 2").first().appid == 11
    assert summary_lookup(s, None, name="doom").first().appid == 12
    assert summary_lookup(s, "", name="").collect() == []


def test_baseline_search(spark):
    from vitrine.operators.search import find_by_name_simple
    dup = spark.createDataFrame([(2, "Portal"), (2, "portal"), (2, "Portal"), (7, None)],
                                "appid bigint, name string")
    df = items(spark).select("appid", "name").unionByName(dup)
    got = [(r["rank"], r.appid, r.name) for r in find_by_name_simple(df, " portal ", 10).collect()]
    # distinct (appid, name) rows in key, name order; no ranking features
    assert got == [(1, 1, "Portal 2"), (2, 2, "Portal"), (3, 2, "portal"), (4, 3, "Portal 2 - Soundtrack"),
                   (5, 6, "Portal")]
    # a blank query matches every named row (first k by key)
    assert [r.appid for r in find_by_name_simple(df, "  ", 3).collect()] == [1, 2, 2]
    assert find_by_name_simple(df, "zzz", 3).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_shortlist_matches_bruteforce(spark):
    import random

    from vitrine.operators.search import fuzzy_shortlist
    rng = random.Random(11)
    words = ["star", "dew", "valley", "stardew", "vale", "sky", "rim", "dark", "soul", "a", "", "stardw valey"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(names)), "appid bigint, name string")
    q = "stardw valey"
    ratio = [1 - edit_distance(n.lower(), q) / max(len(n), len(q)) for n in names]
    want = sorted(range(len(names)), key=lambda i: (-round(ratio[i], 12), i))[:50]
    got = fuzzy_shortlist(df, q, 5).orderBy(F.col("fuzzy_ratio").desc(), "appid").collect()
    assert [r.appid for r in got] == want


def test_batch_equals_single(spark):
    df = items(spark)
    asked = ["portal", " PORTAL 2 ", "hl", "2", "coop", "stardw valey", "zz", "half-life", "", None]
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(asked)], "qid string, text string")
    got = {}
    for r in find_by_name_batch(df, queries, 3).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.appid, r.match_stage))
    for k, text in enumerate(asked):
        single = [(r["rank"], r.appid, r.match_stage) for r in find_by_name(df, text or "", 3).collect()]
        assert sorted(got.get(f"q{k}", [])) == single, text
    assert find_by_name_batch(df, queries.limit(0), 3).count() == 0
    assert find_by_name_batch(df.limit(0), queries, 3).count() == 0


def test_reviews_are_counted_for_hits(spark):
    df = items(spark).drop("review_count")
    reviews = spark.createDataFrame([(6,), (6,), (2,), (4,), (None,)], "appid bigint")
    assert [r.appid for r in find_by_name(df, "portal", 5, reviews=reviews).collect()] == [6, 2, 1, 3]


def test_lookup_reads_names_twice_at_most(spark, tmp):
    """One probe and one pass over the names; reviews only for the hits."""
    from vitrine.plans.bindings import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = find_by_name(t.named_items(), "red widget", 5, reviews=t.part_reviews())._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("part.parquet") == 0 and text.count("lineitem.parquet") <= 1
    assert "Python" not in text and "CartesianProduct" not in text


def test_blank_and_unknown_prompts_meet_no_join(spark):
    q = spark.createDataFrame([(k, " " if k % 2 else f"text {k}") for k in range(50)], "qid int, text string")
    got = resolve_prompts(q, items(spark)).groupBy("mode").count().collect()
    assert {r["mode"]: r["count"] for r in got} == {"error": 25, "semantic": 25}


def test_prompts_match_names_by_full_case_folding(spark):
    items = spark.createDataFrame([(1, "Straße der Ritter"), (2, "ΟΔΟΣ"), (3, "Plain")], "appid bigint, name string")
    asked = spark.createDataFrame([(1, "STRASSE DER RITTER"), (2, "οδος"), (3, "pLAIN"), (4, "strase der ritter")],
                                  "qid int, text string")
    got = {r.qid: (r.mode, r.center_appid) for r in resolve_prompts(asked, items).collect()}
    assert got == {1: ("name", 1), 2: ("name", 2), 3: ("name", 3), 4: ("semantic", None)}


def test_scored_names_are_few_and_exact(spark):
    """The shortlist of every text, from the pairs that can be in it only."""
    import random
    from vitrine.operators.search import _bounds, fuzzy_shortlist, name_similarity, scored_names
    rng = random.Random(9)
    syllables = [c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([2, 3, 4])))
    names = sorted({" ".join(word() for _ in range(rng.choice([1, 2, 3]))) for _ in range(500)})
    rows = [(i, n) for i, n in enumerate(n for n in names for _ in range(60))]
    items = spark.createDataFrame(rows, "appid bigint, name string").repartition(5)
    typo = lambda t: "".join(c for c in t if rng.random() > 0.08) + "x"
    asked = [typo(rng.choice(names)) for _ in range(40)] + ["77", "zzzz", names[0]]
    queries = spark.createDataFrame([(t,) for t in sorted(set(asked))], "__q string")
    distinct = items.groupBy(F.lower("name").alias("__name")).count().withColumnRenamed("count", "__rows")
    scored = scored_names(queries, distinct, 50)
    pairs = scored.select("__q", "__name").collect()
    assert len(pairs) == len(set(pairs))  # each pair once
    everything = queries.count() * len(names)
    assert len(pairs) < 0.05 * everything, (len(pairs), everything)
    for sizes in ((3,), (2, 1), (1,)):  # the bounds hold
        bounds = _bounds(queries, distinct, sizes).withColumn("s", name_similarity(F.col("__name"), F.col("__q")))
        assert bounds.where("s > __ub + 1e-12").isEmpty()
    got = find_by_name_batch(items, queries.select(F.col("__q").alias("qid"), F.col("__q").alias("text")), 5)
    best = {}
    for r in got.collect():
        best.setdefault(r.qid, []).append((r["rank"], r.appid))
    for q in ("77", "zzzz", *sorted(set(asked))[3:6]):
        single = [(r["rank"], r.appid) for r in find_by_name(items, q, 5).collect()]
        assert sorted(best[q]) == single, q
        assert fuzzy_shortlist(items, q, 5).count() == 50
