"""Sources and sinks on small files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.sources import binary, csv, parquet, records


def test_quoted_multiline_csv(spark, tmp):
    p = os.path.join(tmp, "r.csv")
    with open(p, "w") as f:
        f.write('id,text\n1,"line one\nline two"\n2,"say ""hi"""\n3,plain\n')
    quoted = csv.read_csv(spark, p, quoted=True)
    plain = csv.read_csv(spark, p, quoted=False)
    assert quoted.count() == 3 and plain.count() == 4
    assert quoted.where("id = '2'").first().text == 'say "hi"'


def test_raw_vectors(spark, tmp):
    mat = np.arange(40, dtype="<f4").reshape(10, 4)
    p = os.path.join(tmp, "v.npy.raw")
    mat.tofile(p)
    df = binary.read_vectors(spark, p, dim=4, expected_rows=10)
    rows = {r.vector_index: r.embedding for r in df.collect()}
    assert rows[9] == [36.0, 37.0, 38.0, 39.0]
    with pytest.raises(ValueError):
        binary.read_vectors(spark, p, dim=3)
    with pytest.raises(ValueError):
        binary.read_vectors(spark, p, dim=4, expected_rows=11)
    m = spark.createDataFrame([("620", 9), ("440", 0)], "appid string, vector_index long")
    got = {r.appid: r.embedding[0] for r in binary.align_vectors(df, m).collect()}
    assert got == {"620": 36.0, "440": 0.0}


def test_optional_and_resumable_append(spark, tmp):
    schema = T.StructType([T.StructField("appid", T.LongType()), T.StructField("summary", T.StringType())])
    path = os.path.join(tmp, "s.parquet")
    assert parquet.read_optional(spark, path, schema).count() == 0
    batch = spark.createDataFrame([(1, "a"), (2, None)], schema)
    assert parquet.append_new(spark, batch, path, "appid", schema) == 2
    more = spark.createDataFrame([(2, "b"), (3, "c")], schema)
    assert parquet.append_new(spark, more, path, "appid", schema) == 1
    got = sorted((r.appid, r.summary) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a"), (2, None), (3, "c")]


def test_json_safe(spark):
    df = spark.createDataFrame([(1, float("inf"), None), (2, float("nan"), "d"), (3, 0.5, None)],
                               "appid int, x double, short_description string")
    got = [tuple(r) for r in records.json_safe(df).orderBy("appid").collect()]
    assert got == [(1, None, ""), (2, None, "d"), (3, 0.5, "")]
    lines = [r.value for r in records.to_json_lines(df).orderBy("value").collect()]
    assert lines[0].startswith('{"appid":1')


def _quoted_files(folder, rng, breaks="\n"):
    """Two files of records with breaks, doubled quotes, blanks and empty fields."""
    import os
    want = []
    for k in range(2):
        with open(os.path.join(folder, f"f{k}.csv"), "w", newline="") as f:
            f.write(f'a,"b",c{breaks}')
            for i in range(160):
                fields = []
                for _ in range(3):
                    text = rng.choice(["", "x", "plain text", f"row {i}", 'say ""hi""', f"line{breaks}break",
                                       f'""{breaks}{breaks}""', ",", f"long {breaks.join('word' * 9 for _ in range(6))}"])
                    quote = rng.random() < 0.3 or any(c in text for c in ',"\n\r')
                    fields.append(f'"{text}"' if quote else text)
                f.write(",".join(fields) + (breaks if i < 159 or k else ""))
    return want


def test_quoted_csv_is_read_by_many_tasks(spark, tmp):
    """Ranges of a few bytes, so that every kind of place is the edge of one."""
    import os
    import random
    from vitrine.sources.csv import quoted_records, read_csv, read_quoted
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for n, breaks in enumerate(["\n", "\r\n"]):
            folder = os.path.join(tmp, f"d{n}")
            os.makedirs(folder)
            _quoted_files(folder, random.Random(n), breaks)
            want = key(read_csv(spark, folder))
            for size in (64, 97, 1000, 1 << 20):
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
                spark.conf.set("spark.sql.files.openCostInBytes", "1")
                assert key(read_quoted(spark, folder)) == want, (breaks, size)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
            one = os.path.join(folder, "f0.csv")
            assert quoted_records(spark, one).select("start").distinct().count() > 5
            assert len(want) > 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_quoted_csv_edges(spark, tmp):
    import os
    from vitrine.sources.csv import read_csv, read_quoted
    for name, text in {"head": "a,b\n", "open": 'a,b\n1,"x\ny\nz', "short": 'a,b,c\n1\n1,2,3,4\n\n"q",,\n'}.items():
        path = os.path.join(tmp, f"{name}.csv")
        with open(path, "w", newline="") as f:
            f.write(text)
        assert sorted(map(str, map(tuple, read_quoted(spark, path).collect()))) == \
            sorted(map(str, map(tuple, read_csv(spark, path).collect()))), name


def test_vector_file_is_split_without_rdd(spark, tmp):
    import os
    import numpy as np
    from vitrine.sources.binary import read_vectors
    path = os.path.join(tmp, "v.f32")
    mat = np.arange(1000 * 8, dtype="<f4").reshape(1000, 8)
    mat.tofile(path)
    df = read_vectors(spark, path, 8, expected_rows=1000, partition_bytes=3000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "RDD" not in plan
    assert df.select(F.spark_partition_id()).distinct().count() == 11
    got = {r.vector_index: r.embedding for r in df.collect()}
    assert got == {i: row.tolist() for i, row in enumerate(mat)}
    for bad in ({"dim": 7}, {"dim": 8, "expected_rows": 999}):
        with pytest.raises(ValueError):
            read_vectors(spark, path, **bad)
