import os
import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: names the operators use inside, as extra columns of a table
CLASHES = ("score", "kept", "marks", "body", "bucket", "doc_key", "n_words", "fp", "label", "rank", "part")


def clashing(df):
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


def odd_rows(seed=5, n=60):
    """Rows with copies, shared passages, nulls, empty and very long texts, ties
    and repeated rows; ids are unique except for the repeated row 7."""
    rng = random.Random(seed)
    words = ["the", "THEN", "über", "ça", "x", "data,", "row.", "日本", "a-b", "it's"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [line(rng.randint(14, 40)) for _ in range(4)]
    rows = []
    for i in range(1, n):
        rows.append((i, "\n".join(rng.choice(passages) if rng.random() < 0.4 else line(rng.randint(1, 25))
                                  for _ in range(rng.randint(1, 5)))))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, line(30_000)), (105, rows[3][1]),
             (106, rows[3][1]), (107, "aa " * 400), (108, "a" * 700), rows[6], (109, "a" * 300)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with clashing extra columns, over several partitions."""
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", None if t is None else len(t))
                                for i, t in odd_rows()],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return clashing(df).repartition(5).cache()


@pytest.fixture(scope="session")
def empty_docs(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(os.path.join(SF, "labels.parquet"))
