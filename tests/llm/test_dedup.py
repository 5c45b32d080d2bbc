"""Substring, suffix-array and SimHash dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from vitrine.llm import simhash, substring_dedup, suffix_dedup
from vitrine.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, width):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k:k + width]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def brute_bytes(rows, size=suffix_dedup.LENGTH):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            first.setdefault(b[k:k + size], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if i is not None and first[b[k:k + size]] < i:
                gone[k:k + size] = b"\1" * size
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_substring_dedup_matches_brute_force(odd):
    expected = brute_words(rows_of(odd), 13)
    got = substring_dedup.substring_dedup(odd, 13, carry=("doc_id", "score")).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == expected[r.doc_id]
        assert r.score == "extra score"
        assert sum(e - s for s, e in zip(r.span_starts, r.span_ends)) == r.n_removed


def test_substring_dedup_small_blocks(odd, monkeypatch):
    """What blocks decide and what buckets decide must agree."""
    import pyarrow as pa
    rows = sorted((r for r in rows_of(odd) if r[0] is not None and r[1]), key=lambda r: r[0])
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    run = substring_dedup._window_packets(13, 7)
    for cut in (1, 9, len(rows)):
        batches = [pa.RecordBatch.from_pydict({
            "doc_id": pa.array([i for i, _ in rows[k:k + cut]], pa.int64()),
            "doc_key": pa.array([1 for _ in rows[k:k + cut]], pa.int64()),
            "body": pa.array([t.encode() for _, t in rows[k:k + cut]], pa.binary())}) for k in range(0, len(rows), cut)]
        packets = pa.Table.from_batches(list(run(iter(batches))))
        marks = {}
        for b in set(packets.column("bucket").to_pylist()):
            one = packets.filter(pa.array([x == b for x in packets.column("bucket").to_pylist()]))
            parts = substring_dedup._mark_repeated(one, 3)
            done = substring_dedup.P.gather(1)(parts) if parts.num_rows else None
            for i, m in zip(*(done.column(c).to_pylist() for c in ("doc_id", "marks"))) if done else ():
                marks.setdefault(i, set()).update(np.frombuffer(m, "<i4").tolist())
        expected = brute_words(rows, 13)
        for i, t in rows:
            gone = {p + k for p in marks.get(i, ()) for k in range(13)}
            assert len(gone) == expected[i][1], (cut, i)


def test_very_long_texts_in_slices(spark, monkeypatch):
    """Slices of a few words, and words longer than a slice, give the same rows."""
    rng = np.random.default_rng(8)
    words = ["a", "bb", "ccc", "d" * 900, "über"]
    long = " ".join(rng.choice(words, 3000)) + "\n \t" + " ".join(f"w{k}" for k in range(400))
    rows = [(1, long[:9000]), (2, "x " + long), (3, long), (4, "z " * 30 + long[5000:]), (5, "d" * 5000)]
    expected = brute_words(rows, 13)
    want = [simhash.fingerprint(t.encode()) for _, t in rows]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "SLICE", 700)
    monkeypatch.setattr(simhash, "SLICE", 600)
    assert [simhash.fingerprint(t.encode()) for _, t in rows] == want
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([i for i, _ in rows], pa.int64()), "doc_key": pa.array([0] * 5, pa.int64()),
        "body": pa.array([t.encode() for _, t in rows], pa.binary())})
    packets = pa.Table.from_batches(list(substring_dedup._window_packets(13, 1)(iter([batch]))))
    done = substring_dedup.P.gather(1)(substring_dedup._mark_repeated(packets, 1))
    marks = dict(zip(done.column("doc_id").to_pylist(), done.column("marks").to_pylist()))
    cut = substring_dedup._cut(13, False, ["doc_id"])
    rest = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "body": batch.column("body"),
                                       "marks": pa.array([marks.get(i) for i, _ in rows], pa.binary())})
    for out in cut(iter([rest])):
        for r in out.to_pylist():
            assert (r["n_words"], r["n_removed"], r["kept"].decode()) == expected[r["doc_id"]]


def test_suffix_dedup_matches_brute_force(odd):
    expected = brute_bytes(rows_of(odd))
    got = suffix_dedup.suffix_dedup(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[r.doc_id]
    digests = {r.doc_id: r.kept for r in suffix_dedup.suffix_dedup(odd, digest=True).collect()}
    assert digests[104] == hashlib.sha256(expected[104][3]).hexdigest()


def test_segments_and_triggers():
    """Every string has one trigger, whatever the segments."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (0, 49, 50, 51, 3000)] + [b"a" * 500]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def found(limit):
        out = set()
        for seg in suffix_dedup.segments(data, offsets, limit):
            place, lo, hi, part, _ = suffix_dedup.triggers(seg)
            shift = seg.first[part] - seg.bound[part]
            for r, p, a, b in zip(seg.row[part], place + shift, lo + shift, hi + shift):
                out.update((int(r), int(s), int(p)) for s in range(a, b + 1))
        return out
    whole = found(1 << 20)
    assert whole == found(200) == found(1000)
    assert sorted((r, s) for r, s, _ in whole) == [
        (r, s) for r, t in enumerate(texts) for s in range(len(t) - suffix_dedup.LENGTH + 1)]


def test_removed_strings_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(2, 60))
        base = rng.integers(97, 99, 80, dtype=np.uint8)
        before, after = rng.integers(0, 31, n), rng.integers(20, 51, n)
        owner = rng.integers(0, 12, n)
        body = []
        for b, a in zip(before, after):
            one = base.copy()
            one[rng.integers(0, 80, 2)] = 97
            body.append(one[30 - b:30 + a])
        gone = suffix_dedup.removed_strings(owner, before, after, np.concatenate(body))
        least = {}
        for i in range(n):
            for o in range(31):
                if o <= before[i] and after[i] >= 50 - o:
                    s = (o, bytes(body[i][before[i] - o:before[i] - o + 50]))
                    least[s] = min(least.get(s, 99), owner[i])
        for i in range(n):
            for o in range(31):
                if o <= before[i] and after[i] >= 50 - o:
                    assert gone[i, o] == (owner[i] > least[(o, bytes(body[i][before[i] - o:before[i] - o + 50]))])
                else:
                    assert not gone[i, o]


def brute_fingerprint(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    grams = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash_matches_brute_force(odd):
    rows = sorted(rows_of(odd), key=lambda r: r[0])
    prints = [brute_fingerprint(t) for _, t in rows]
    arr = np.array(prints, np.uint64)
    near = np.argwhere(np.bitwise_count(arr[:, None] ^ arr[None]) <= 4)
    root = classes(len(rows), near)
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    expected = {i: (p, rows[r][0]) for (i, _), p, r in zip(rows, prints, root)}
    for r in got:
        assert (r.fp % (1 << 64), r.component_id) == expected[r.doc_id]


def test_gray_index_matches_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(20):
        base = rng.integers(0, 1 << 63, max(1, trial), dtype=np.uint64)
        codes = base[rng.integers(0, len(base), 300)]
        for _ in range(5):
            flip = rng.integers(0, 64, len(codes)).astype(np.uint64)
            codes = codes ^ ((np.uint64(1) << flip) * (rng.random(len(codes)) < 0.6).astype(np.uint64))
        codes = np.unique(codes)
        cells = rng.integers(0, 3, len(codes))
        a, b = simhash.link_cells(codes, cells, 4)
        place = {int(c): k for k, c in enumerate(codes)}
        near = np.argwhere((np.bitwise_count(codes[:, None] ^ codes[None]) <= 4) & (cells[:, None] == cells[None]))
        assert classes(len(codes), [(place[int(x)], place[int(y)]) for x, y in zip(a, b)]) == classes(len(codes), near)
        assert len(a) < len(codes)


def test_choices_cover_every_close_pair():
    rng = np.random.default_rng(3)
    for n in (10, 10 ** 8, 10 ** 11):
        masks = simhash.choices(n, 4)
        for _ in range(200):
            x = 0
            for bit in rng.choice(64, 4, replace=False):
                x |= 1 << int(bit)
            assert any(not x & m for m in masks)


def test_hot_cells_are_split(spark, monkeypatch):
    """A block value beyond ``CHUNK`` codes loses no link."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(8)
    codes = {int(x) for x in rng.integers(0, 1 << 62, 40)} | {1 << k for k in range(60)} | {0}
    df = spark.createDataFrame([(c,) for c in codes], "fp bigint")
    got = {r.a: r.b for r in components(simhash.links(df, 4)).collect()}
    arr = np.array(sorted(codes), np.uint64)
    near = np.argwhere(np.bitwise_count(arr[:, None] ^ arr[None]) <= 4)
    root = classes(len(arr), near)
    assert [got.get(int(c), int(c)) for c in arr] == [int(arr[r]) for r in root]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (20, 10), (30, 10), (30, 31)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {2: 1, 3: 1, 9: 7, 8: 7, 20: 10, 30: 10, 31: 10} | {k: 100 for k in range(101, 161)}


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup,
                                      simhash.near_duplicates])
def test_empty_and_null_ids(spark, empty_docs, operator):
    assert operator(empty_docs).count() == 0
    same = "to be or not to be that is the question whether it is nobler in the mind to suffer " * 2
    df = spark.createDataFrame([(None, same), (None, same), (3, same), (4, same)], "doc_id bigint, text string")
    got = operator(df).collect()
    assert len(got) == 4
    if operator is simhash.near_duplicates:
        assert {r.component_id for r in got} == {3}
    else:
        removed = sorted((r.doc_id or 0, r.n_removed > 0) for r in got)
        assert removed == [(0, False), (0, False), (3, False), (4, True)]


def test_parse_order_is_byte_order():
    """Sorting by phrase ranks sorts the texts; no phrase begins another one."""
    rng = np.random.default_rng(12)
    for letters, n in ((2, 400), (26, 900), (3, 1)):
        rows = rng.integers(97, 97 + letters, (n, 50), dtype=np.uint8)
        rows[n // 2:] = rows[rng.integers(0, n, n - n // 2)]  # repeats
        rows[::7, 30:] = 0  # shorter texts, as they are padded
        ends = suffix_dedup._phrases(rows)
        row, rank, size = suffix_dedup._dictionary(rows, ends)
        phrases = {}
        for i in range(n):
            stops = np.flatnonzero(ends[i]) + 1
            parts = [rows[i, a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops)]
            assert b"".join(parts) == rows[i].tobytes()
            for part, r in zip(parts, rank[row == i].tolist()):
                assert phrases.setdefault(part, r) == r
            # a phrase that its own bytes ended is no beginning of a longer one
        whole = {p for i in range(n) for p in [rows[i, :np.flatnonzero(ends[i])[0] + 1].tobytes()] if len(p) < 50}
        assert not any(a != b and b.startswith(a) for a in list(whole)[:60] for b in whole)
        assert len(phrases) == size and sorted(phrases, key=lambda p: phrases[p]) == sorted(phrases, key=lambda p: p.ljust(50, b"\0"))
        order = suffix_dedup._parse_order(rows)
        sorted_rows = [rows[i].tobytes() for i in order]
        assert sorted_rows == sorted(sorted_rows)
        back = [rows[i].tobytes() for i in suffix_dedup._end_order(rows)]
        assert back == sorted(back)

