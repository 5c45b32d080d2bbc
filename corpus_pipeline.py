"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's ``docs``; each calls one operator of
``vitrine.llm`` on all that the stage before kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm.decontaminate import contaminated
from vitrine.llm.packing import SIZE, best_fit_packing
from vitrine.llm.quality_net import fit_quality, score_quality
from vitrine.llm.simhash import DISTANCE, SHINGLE, survivors
from vitrine.llm.substring_dedup import WIDTH, substring_dedup

#: columns of a row's key inside a stage
ROW = ("__row_a", "__row_b")
#: a document leaks an item of at least so many words
ITEM_WORDS = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more; null and empty texts are
    scored like any other."""
    net = fit_quality(docs, C.read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, net, tuple(docs.columns)).toDF(*docs.columns, "__score")
    return scored.where(F.col("__score") >= 0.5).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest
    id, of equal ids the one with the smallest hash of its row, of equal rows one.
    Rows without id are grouped like any other and yield to rows with one; null and
    empty texts are one group."""
    rows = C.row_key(docs, ROW)
    first = survivors(rows, ROW, SHINGLE, DISTANCE)
    return rows.join(first, list(ROW), "left_semi").dropDuplicates(list(ROW)).select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words that repeated windows cover; a null text
    becomes an empty one."""
    cut = substring_dedup(docs, WIDTH, carry=tuple(docs.columns)).toDF(
        *docs.columns, "__words", "__removed", "__starts", "__ends", "__kept")
    changed = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast("bigint")}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, least_words: int = ITEM_WORDS) -> DataFrame:
    """Documents that cover no benchmark item of ``least_words`` words or more (a
    single word is no leak). Each row is judged by its own
    text, with or without id; null and empty texts stay."""
    rows = C.row_key(docs, ROW)
    leaks = contaminated(rows, C.read_table(spark, sf_dir, "benchmark"), short_items=True, carry=ROW).where(
        F.col("item_words") >= least_words).select(*ROW).distinct()
    return rows.join(leaks, list(ROW), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the packed sequences."""
    out = best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), SIZE)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substrings),
          ("benchmark_decontamination", decontaminate), ("best_fit_packing", packing)]

#: no SQL can express the classifier, the index or the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = C.work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
