"""A memo of generated texts that outlives a call.

Rewriting a prompt costs a model call; people type the same prompts again. The memo
keeps every answer under the hash of its text, in a versioned table
(:mod:`vitrine.sources.versions`): a call reads the answers it needs by an equi-join,
generates only the texts that are not there, and commits those together with the
time at which every text was asked for.

Eviction is by age: an answer not asked for within ``max_age_days`` is neither used
nor kept by :meth:`PromptMemo.evict`, which also folds the notes of use into one per
text. Failed generations are not kept, so they are tried again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.enrich import clean_response, generate
from vitrine.sources.versions import VersionLog

MAX_AGE_DAYS = 90
ANSWERS = T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType()),
                        T.StructField("response", T.StringType())])
USES = T.StructType([T.StructField("key", T.StringType()), T.StructField("used_at", T.TimestampType())])


class PromptMemo:
    def __init__(self, spark: SparkSession, root: str, max_age_days: float = MAX_AGE_DAYS) -> None:
        self.spark, self.log, self.max_age = spark, VersionLog(spark, root), timedelta(days=max_age_days)

    def _live(self, now: datetime) -> DataFrame:
        """The answers asked for recently enough, with their last use."""
        version = self.log.current()
        uses = self.log.read(version, "uses", USES).groupBy("key").agg(F.max("used_at").alias("used_at")).where(
            F.col("used_at") >= F.lit(now - self.max_age))
        # an answer generated twice (after it had aged) counts once
        answers = self.log.read(version, "answers", ANSWERS).groupBy("key", "text").agg(
            F.max("response").alias("response"))
        return answers.join(uses, "key")

    def rewrite(self, df: DataFrame, make_fn: Callable[[], Callable[[str], str | None]], input_col: str = "text",
                output_col: str = "rewritten", tasks: int | None = None, now: datetime | None = None) -> DataFrame:
        """:func:`vitrine.operators.enrich.generate_distinct` through the memo: each
        distinct text that it does not know is generated once and kept."""
        now = now or datetime.now(timezone.utc)
        asked = df.select(F.col(input_col).alias("text")).where(F.col("text").isNotNull()).distinct().withColumn(
            "key", F.sha2("text", 256)).checkpoint()
        known = self._live(now).select("key", "text", "response")
        missing = asked.join(known, ["key", "text"], "left_anti")
        base, commit = self.log.current(), self.log.new_commit()
        made = generate(missing, make_fn, "text", "response", tasks).withColumn(
            "response", clean_response("response")).where(F.col("response").isNotNull())
        # one pass over the generator's rows: what is kept is what is returned
        self.log.write(made.select(*ANSWERS.names), "answers", commit)
        self.log.write(asked.select("key", F.lit(now).cast("timestamp").alias("used_at")), "uses", commit)
        self.log.commit(base, commit, {"answers": None, "uses": None})
        answers = self._live(now).select(F.col("text").alias(input_col), "response")
        return df.join(answers, input_col, "left").withColumn(
            output_col, F.coalesce("response", F.col(input_col))).drop("response").select(*df.columns, output_col)

    def evict(self, now: datetime | None = None) -> int:
        """Drop the answers that have aged; returns how many are left."""
        base, commit = self.log.current(), self.log.new_commit()
        live = self._live(now or datetime.now(timezone.utc)).checkpoint()
        self.log.write(live.select(*ANSWERS.names), "answers", commit)
        self.log.write(live.select(*USES.names), "uses", commit)
        self.log.commit(base, commit, {"answers": None, "uses": None}, {"answers": None, "uses": None})
        return live.count()
