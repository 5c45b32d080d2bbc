"""Registered queries against their SQL twins, and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from vitrine.llm import common as C
from vitrine.llm import decontaminate, registry, simhash
from vitrine.llm.quality_net import fit_quality, score_quality
from vitrine.llm.substring_dedup import substring_dedup

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert names["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("key", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(registry.ORACLE_SQL[key])
    columns = [d[0] for d in cursor.description]
    df = registry.QUERIES[key](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key_of = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=key_of) == sorted(cursor.fetchall(), key=key_of)


def test_stages_take_effect(spark):
    docs = C.read_table(spark, SF, "documents")
    columns = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    net = fit_quality(docs, C.read_table(spark, SF, "labels"))
    good = {r.doc_id for r in score_quality(docs, net).where("score >= 0.5").collect()}
    stage = [f for _, f in corpus_pipeline.STAGES]
    one = C.through_table(stage[0](spark, docs, SF), "t")
    assert one.columns == columns and {r.doc_id for r in one.collect()} == good and len(good) < docs.count()
    two = C.through_table(stage[1](spark, one, SF), "t")
    least = {r.component_id for r in simhash.near_duplicates(one).collect()}
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(least)
    three = C.through_table(stage[2](spark, two, SF), "t")
    text = {r.doc_id: r.kept for r in substring_dedup(two).collect()}
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == text
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = C.through_table(stage[3](spark, three, SF), "t")
    leaks = {r.doc_id for r in decontaminate.contaminated(three, C.read_table(spark, SF, "benchmark"), short_items=True).where(
        F.col("item_words") >= corpus_pipeline.ITEM_WORDS).collect()}
    assert four.columns == columns and {r.doc_id for r in four.collect()} == set(text) - leaks
    five = stage[4](spark, four, SF).collect()
    assert {r.doc_id for r in five} == set(text) - leaks


def test_stages_with_odd_rows(spark, odd, empty_docs):
    """Clashing extra columns, nulls, repeated rows and empty tables."""
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert {r.score for r in out.collect()} <= {"extra score"}
        assert f(spark, empty_docs, SF).count() == 0
    kept = corpus_pipeline.near_dedup(spark, odd, SF).collect()
    assert len({r.doc_id for r in kept}) == len(kept)
    assert corpus_pipeline.packing(spark, empty_docs, SF).count() == 0


def test_rows_are_judged_by_themselves(spark, tmp_path):
    """Rows that share an id or have none: no clean row is lost, no copy stays."""
    a, b = "alpha beta gamma delta " * 9, "one two three four five six " * 8
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (None, b), (None, b), (None, None), (7, "")],
                                 "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (5, b), (7, "")]
    alone = docs.where("doc_id is null and text is not null")
    assert [tuple(r) for r in corpus_pipeline.near_dedup(spark, alone, SF).collect()] == [(None, b)]
    item = "which of these seven words is the kappa answer"
    spark.createDataFrame([(1, item), (2, "kappa")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"so {item} then"), (3, f"so {item} then"), (3, "a clean namesake"), (None, None),
                                  (None, "clean"), (4, "kappa alone")], "doc_id bigint, text string").repartition(2)
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [
        ("3", "a clean namesake"), ("4", "kappa alone"), ("None", "None"), ("None", "clean")]
    all_words = corpus_pipeline.decontaminate(spark, docs, str(tmp_path), least_words=1).collect()
    assert "kappa alone" not in {r.text for r in all_words}
