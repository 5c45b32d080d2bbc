"""Decontamination and exact top-k against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import decontaminate, inner_product
from vitrine.llm.decontaminate import tile


def brute_tiling(text, item, least):
    text_used, item_used, out = [False] * len(text), [False] * len(item), 0
    while True:
        best, found = least - 1, []
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] \
                        and not item_used[p + n] and not text_used[t + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((p, t))
        if best < least:
            return out
        for p, t in found:
            if not any(item_used[p:p + best]) and not any(text_used[t:t + best]):
                item_used[p:p + best] = text_used[t:t + best] = [True] * best
                out += best


def test_tiling_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 40))]
        item = [rng.randint(0, 3) for _ in range(rng.randint(0, 20))]
        if len(item) > 8:
            text[5:5] = item[4:9] + [9] + item[:4]
        tiles = tile(np.array(text, np.uint64), np.array(item, np.uint64), 3)
        assert sum(n for _, _, n in tiles) == brute_tiling(text, item, 3)
        used = [p for a, b, n in tiles for p in range(b, b + n)]
        assert len(used) == len(set(used))
        assert all(text[a:a + n] == item[b:b + n] for a, b, n in tiles)


def test_contaminated(spark, odd):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.sample(words, 24))) for k in range(6)]
    items += [(10, None), (11, ""), (12, "one two three"), (0, items[0][1])]
    part = [items[k][1].split() for k in range(6)]
    texts = {
        1: " ".join(part[0]).upper() + "!", 2: "x, ".join(["", *part[1][:8]]),
        3: " ".join(["pre"] * 9 + part[2][12:] + ["mid"] * 3 + part[2][:12] + ["post"] * 900),  # halves swapped
        4: " ".join(part[3][:9] + ["cut"] + part[4][:9]), 5: None, 6: "", 7: "one two three",
        8: ". ".join([" ".join(part[5][k:k + 6]) for k in (18, 6, 12, 0)])}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id bigint, text string").withColumn(
        "item_id", F.lit(77)).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(9))
    got = decontaminate.contaminated(docs, bench).collect()
    found = sorted((r.doc_id, r.item_id, r.matched_words, r.tiles) for r in got)
    assert found == [(1, 0, 24, 1)] * 4 + [(3, 2, 24, 2), (8, 5, 24, 3)]
    carried = decontaminate.contaminated(docs.withColumn("tiles", F.lit("t")), bench, carry=("tiles",))
    assert carried.columns[:2] == ["doc_id", "tiles"]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, bench).count() == 0


def test_common_seeds_are_left_out_exactly(spark):
    """A sentence that all items share: only candidates that can reach the threshold
    are tiled, and nothing of the plain definition (all pairs) is lost."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    frame = "which of the following is the best answer to the question below".split()
    items = [(k, " ".join(frame + rng.sample(words, rng.choice([3, 8, 12, 30])))) for k in range(60)]
    texts = []
    for d in range(150):
        body = rng.sample(words, 20)
        for _ in range(rng.randint(0, 3)):
            item = items[rng.randrange(60)][1].split()
            cut = rng.randrange(len(item))
            body += rng.choice([frame, item, item[cut:] + ["x"] + item[:cut], item[:cut]]) + rng.sample(words, 3)
        texts.append((d, " ".join(body)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.matched_words, r.tiles)
                 for r in decontaminate.contaminated(docs, bench, short_items=True).collect())
    hashes = lambda t: np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint64)
    want = []
    for d, text in texts:
        for i, item in items:
            tiles = tile(hashes(text), hashes(item))
            if sum(t[2] for t in tiles) >= 0.5 * len(item.split()):
                want.append((d, i, sum(t[2] for t in tiles), len(tiles)))
    assert got == sorted(want) and len(got) > 50
    table = decontaminate.item_table(bench)
    every = table.selectExpr("item", "explode(array_distinct(seeds)) seed")
    kept = decontaminate.candidate_seeds(table)
    frame_seeds = every.groupBy("seed").count().where("count > 16").select("seed")
    # long items never come up by the common sentence, short ones must
    left = kept.join(frame_seeds, "seed", "left_semi").select("item").distinct().count()
    assert 0 < left < 60 and kept.count() < every.count()


def test_short_and_unsegmented_items_are_found(spark, tmp_path):
    items = {1: "Where is it?", 2: "forty-two", 3: "abacus", 4: "今天天气很好，我们去公园散步。", 5: "ประเทศไทยมีภูเขา",
             6: "これは長い質問の文です", 7: "one two three four «five» six", 8: "x y z w"}
    texts = {1: "So where, is IT then", 2: "where it is", 3: "the forty two of them", 4: "he said:今天天气很好 我们去公园散步!",
             5: "在ประเทศไทยมีภูเขาmore", 6: "x y z", 7: "かれ「これは長い質問の文です」と", 8: "a one two three four “five”… six b",
             9: "abacuses", 10: "today 天气 is 很好", 11: "an abacus and an ABACUS", 12: "x y z w", 13: "y x y z w"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(2).write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontaminate.op6_decontaminate(spark, str(tmp_path)).collect()
    found = sorted((r.doc_id, r.item_id, r.item_words, r.matched_words) for r in got)
    assert found == [(1, 1, 3, 3), (3, 2, 2, 2), (4, 4, 13, 13), (5, 5, 16, 16), (7, 6, 11, 11), (8, 7, 6, 6),
                     (11, 3, 1, 1), (12, 8, 4, 4), (13, 8, 4, 4)]
    import corpus_pipeline
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    # a single word is reported, but drops a document on request only
    assert sorted(r.doc_id for r in kept) == [2, 6, 9, 10, 11]
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path), least_words=1).collect()
    assert sorted(r.doc_id for r in kept) == [2, 6, 9, 10]


def test_words_match_the_plain_definition():
    rng = random.Random(4)
    kinds = decontaminate.kinds()
    for _ in range(300):
        texts = ["".join(rng.choice("aB ß-é，。日本กข\u3000\u200b«»😀𠀀½") for _ in range(rng.randint(0, 12))).encode()
                 for _ in range(3)] + [b"\xe6\x97", b"\xa5\xf0\x9f x"]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start, end, first = C.word_bounds(data, offsets, decontaminate.IS_BREAK, decontaminate._refine)
        got = [[data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(first[:-1], first[1:])]
        for t, words in zip(texts[:3], got):
            line = "".join(f" {c} " if kinds[ord(c)] == 2 else " " if c in " -" or kinds[ord(c)] == 1 else c
                           for c in t.decode())
            assert words == [w.encode() for w in line.split(" ") if w]
        assert got[3:] == [[b"\xe6\x97"], [b"\xa5\xf0\x9f", b"x"]]


def brute_top(rows, queries, k):
    out = {}
    for q, v in queries:
        score = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in score[:k]]
    return out


def vectors(spark, rows):
    return inner_product.integer_vectors(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("extra")))


def test_top_k_matches_brute_force(spark, monkeypatch):
    for name, size in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 4), ("SAMPLE_ROWS", 20), ("ROUND_BYTES", 900)):
        monkeypatch.setattr(inner_product, name, size)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1 + i % 3, 6)]) for i in range(140)]
    rows += [(200 + i, rows[7][1]) for i in range(9)] + [(300, [0.0] * 6), (350, [-1.0] * 6)]
    ints = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    table = vectors(spark, rows).repartition(3)
    got = {}
    for r in inner_product.top_k(table, table.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    expected = brute_top(ints, [x for x in ints if x[0] % 50 == 0], 5)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == expected
    assert all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())


def test_pruning_scores_few_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (4000, 32)) * np.linspace(3, 0.05, 32)
    vecs = np.floor(256 * base * rng.uniform(0.1, 2, (4000, 1))).astype(np.int64)
    turn = inner_product.rotation(vecs[:500])
    search = inner_product.Search(np.arange(40), vecs[:40], turn, 5)
    search.add(np.arange(4000), vecs)
    assert search.scored < 40 * 4000 / 5
    scores = vecs[:40] @ vecs.T
    scores[np.arange(40), np.arange(40)] = -(1 << 62)
    for q in range(40):
        best = np.lexsort((np.arange(4000), -scores[q]))[:5]
        mine = search.found[0] == q
        assert search.found[1][mine].tolist() == best.tolist()


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, None]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (1, [1.0, 2.0]),
            (1, [1.0, 2.0]), (None, [9.0, 9.0]), (2, [1.0, 2.0, 3.0]), (250, [1.0, 2.0, 3.0]), (0, [1.0, 2.0]), (300, [])]
    table = vectors(spark, rows)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in inner_product.top_k(
        table, table.where("vec_id % 50 = 0"), 5).collect())
    same = 256 * 256 * 5
    assert got == [(0, 1, 1, same), (0, 2, 1, same), (250, 1, 2, 256 * 256 * 14)]
    none = table.limit(0)
    assert inner_product.top_k(none, none, 5).count() == 0
