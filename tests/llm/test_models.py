"""Quality network and language ID: gradients, exact code lengths, held-out accuracy."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import language_ppm, quality_net
from vitrine.llm.language_ppm import ORDER, ContextTrees
from vitrine.llm.quality_net import STEP, WIDTH, ByteNet

SF = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def laid(texts):
    return (np.frombuffer(b"".join(texts), np.uint8),
            np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))


def test_scores_cover_every_chunk(monkeypatch):
    """Slabs of any size give the score of the plain definition."""
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, WIDTH - 1, WIDTH, WIDTH + 1, 700, 5000)]
    net = ByteNet()
    net.fitted = True
    expected = []
    for t in texts:
        ids = ByteNet.padded(np.frombuffer(t, np.uint8))
        n = (len(ids) - WIDTH) // STEP + 1
        chunks = np.stack([net.w["embed"][ids[k * STEP:k * STEP + WIDTH]].ravel() for k in range(n)])
        assert n * STEP + WIDTH - STEP >= len(t)
        logit = net._head((chunks @ net.w["filters"]).max(axis=0)[None])[2][0]
        expected.append(1 / (1 + math.exp(-logit)))
    for slab in (1 << 18, 256, 64):
        monkeypatch.setattr(quality_net, "SLAB_BYTES", slab)
        assert np.allclose(net.scores(*laid(texts)), expected, atol=1e-5)


def test_gradient():
    rng = np.random.default_rng(1)
    net = ByteNet()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    inputs = [ByteNet.padded(rng.integers(0, 256, n).astype(np.uint8)) for n in (10, 90, 200)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        pooled = np.stack([net.responses(i, (len(i) - WIDTH) // STEP + 1).max(axis=0) for i in inputs])
        p = 1 / (1 + np.exp(-net._head(pooled)[2]))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    grad = net._gradient(inputs, labels)
    for name, g in grad.items():
        flat = net.w[name].reshape(-1)
        for k in np.argsort(-np.abs(np.ravel(g)))[:3]:
            keep = flat[k]
            flat[k] = keep + 1e-4
            up = loss()
            flat[k] = keep - 1e-4
            down = loss()
            flat[k] = keep
            assert abs((up - down) / 2e-4 - np.ravel(g)[k]) < 1e-3, name


def test_quality_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = quality_net.fit_quality(docs, labels)
    got = quality_net.score_quality(docs, net).join(labels, "doc_id").where(C_held()).collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in got]
    clean_kept = [r.score >= 0.5 for r in got if r.quality == 1]
    assert len(got) > 80 and np.mean(right) > 0.9 and np.mean(clean_kept) > 0.95


def C_held():
    from vitrine.llm import common
    return common.held_out()


def test_held_out_labels_are_never_learned(spark, docs, labels):
    """Turning the held-out labels round changes nothing."""
    turned = labels.withColumn("quality", F.when(C_held(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_net.labelled_sample(docs, labels), quality_net.labelled_sample(docs, turned)
    assert a[0] == b[0] and (a[1] == b[1]).all() and len(a[0]) > 20
    bodies = {r.text.encode() for r in docs.collect() if not held_out(r.doc_id)}
    assert set(a[0]) <= bodies


def test_quality_odd_rows(spark, odd, empty_docs, labels):
    net = ByteNet()
    net.fitted = True
    got = quality_net.score_quality(odd, net, ("doc_id", "score")).toDF("doc_id", "extra", "score").collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.extra == "extra score" for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert abs(by_id[100] - by_id[101]) < 1e-6  # float32 sums follow the shape of the batch
    assert quality_net.score_quality(empty_docs, net).count() == 0
    none = quality_net.fit_quality(odd, labels.limit(0))
    assert {r.score for r in quality_net.score_quality(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1, 0), (3, None, 0), (None, 0, 0), (5, 1, 0), (5, 1, 1)],
                                "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_net.score_quality(odd, quality_net.fit_quality(odd, one)).collect()} <= {1.0, 0.5}


def brute_bits(texts, body, seen):
    counts = {}
    for t in texts:
        line = [None] * ORDER + list(t)
        for i in range(ORDER, len(line)):
            for k in range(ORDER + 1):
                here = counts.setdefault(tuple(line[i - k:i]), {})
                here[line[i]] = here.get(line[i], 0) + 1
    total, line = 0.0, [None] * ORDER + [x if x in seen else None for x in body]
    for i in range(ORDER, len(line)):
        out, coded = set(), False
        for k in range(ORDER, -1, -1):
            here = {s: n for s, n in counts.get(tuple(line[i - k:i]), {}).items() if s not in out}
            if here:
                whole = sum(here.values()) + len(here)
                if line[i] in here:
                    total -= math.log2(here[line[i]] / whole)
                    coded = True
                    break
                total -= math.log2(len(here) / whole)
                out |= set(here)
        if not coded:
            total += math.log2(256 - len(out))
    return total


def test_code_lengths_match_brute_force(monkeypatch):
    learned = {"x": [b"hello there the theory", b"then they heal", b"a"], "y": ["über die brücke".encode(), b"die brut"]}
    seen = set(b"".join(learned["x"] + learned["y"]))
    trees = ContextTrees(learned)
    texts = [b"the brute hello", b"", "ßxyz über".encode(), b"\x00\xff\xff\xfe", b"th", b"e" * 40]
    expected = [[brute_bits(learned[k], t, seen) for k in ("x", "y")] for t in texts]
    for block in (1 << 20, 16, 5):
        monkeypatch.setattr(language_ppm, "BLOCK_BYTES", block)
        assert np.allclose(trees.total_bits(*laid(texts)), expected, atol=1e-3)


def test_contexts_beyond_the_table_match_brute_force(monkeypatch):
    learned = {"x": [b"hello there the theory", b"then they heal", b"a"], "y": ["über die brücke".encode(), b"die brut"]}
    seen = set(b"".join(learned["x"] + learned["y"]))
    texts = [b"the brute hello", b"", "ßxyz über".encode(), b"\x00\xff\xff\xfe", b"th", b"e" * 40, b"zhe qdie xie"]
    expected = [[brute_bits(learned[k], t, seen) for k in ("x", "y")] for t in texts]
    for cap in (0, 1, 5, 20):
        trees = ContextTrees(learned, max_contexts=cap)
        for block in (1 << 20, 5):
            monkeypatch.setattr(language_ppm, "BLOCK_BYTES", block)
            assert np.allclose(trees.total_bits(*laid(texts)), expected, atol=1e-3)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_ppm.op5_language_ppm(spark, SF).collect()
    assert len(got) == len(lang) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [lang[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert len(out) > 250 and np.mean(out) > 0.98


def test_language_odd_rows(spark, odd, empty_docs):
    trees = language_ppm.learn(odd)
    assert trees.langs == ["en"]
    got = {r.doc_id: r for r in language_ppm.predict(odd, trees).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[104].lang_pred == "en"
    nothing = language_ppm.learn(empty_docs)
    assert {r.lang_pred for r in language_ppm.predict(odd, nothing).collect()} == {"und"}
    assert language_ppm.predict(empty_docs, trees).count() == 0
    turned = odd.withColumn("lang", F.when(C_held(), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in language_ppm.learn(turned).langs


def test_pairs_from_the_counts_equal_whole_contexts():
    rng = np.random.default_rng(5)
    texts = {k: [bytes(rng.choice(list(b"abcdef "[:n]), 300).astype(np.uint8)) for _ in range(3)]
             for k, n in (("x", 3), ("y", 7), ("z", 5))}
    texts["few"] = [b"a"]
    trees = language_ppm.ContextTrees(texts)
    context = rng.integers(0, trees.size ** 3, 4000)
    symbol = rng.integers(0, trees.size, 4000)
    for lang in range(4):
        whole = trees.code_lengths(lang, 3, context)[np.arange(4000), symbol]
        assert np.allclose(trees.pair_bits(lang, context, symbol), whole)


def test_a_hundred_languages_fit_a_worker():
    """The table stays within its bytes, what is beyond it is coded from the counts."""
    import time
    import tracemalloc
    rng = np.random.default_rng(6)
    letters = np.arange(33, 233, dtype=np.uint8)
    texts = {}
    for k in range(100):
        own = rng.permutation(letters)[:60]
        texts[f"l{k:03d}"] = [bytes(rng.choice(own, 4000)) for _ in range(4)]
    trees = language_ppm.ContextTrees(texts)
    assert trees.size > 190 and len(trees.kept) < language_ppm.MAX_CONTEXTS
    body = b"".join(texts["l042"][0][:2000] + b" " for _ in range(50))
    language_ppm._UNFOLDED.clear()
    tracemalloc.start()
    begin = time.time()
    bits = trees.total_bits(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table = language_ppm.unfolded(trees)[1]
    # contexts of fewer bytes are in the table too
    assert table.nbytes < 3 * language_ppm.TABLE_BYTES and peak < 500 << 20
    assert trees.langs[int(bits[0].argmin())] == "l042" and time.time() - begin < 60
    language_ppm._UNFOLDED.clear()
