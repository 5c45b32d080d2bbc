"""WARC archives, packing and token files: round trips and brute force."""

import hashlib
import io
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrine.llm import common as C
from vitrine.llm import packing, token_codes, tokens, warc

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", NAMES)
def test_pieces_encode_like_whole_texts(name, monkeypatch):
    coder, whole = tokens.Encoder(public_tokenizers.path(name)), plain(name)
    assert coder.rule is not None
    odd = "ab'sreTé 　  \x1c\x1d\x85\t\n\r​́ß1٣Σ!?.,-日本İ<|>ῼ\x1f"

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.one_of(st.sampled_from(odd), st.characters(exclude_categories=("Cs",))), max_size=30))
    def same(text):
        assert coder.ids([text])[0] == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
    same()
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    small = tokens.Encoder(public_tokenizers.path(name))
    texts = ["One two, three. one", "", "two three <|endoftext|> four\n\nfive", "don't Don't 's"]
    assert small.ids(texts) == coder.ids(texts) == [
        array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_get_the_ids_of_the_library(spark, name):
    """The operators' encoder against an unmodified tokenizer."""
    path = public_tokenizers.path(name)
    coder, whole = tokens.encoder(path), Tokenizer.from_file(path)
    assert coder.rule is not None
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " one", "Two ", "\n", "ß", "日本", "İ", "."]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(parts), max_size=8).map("".join), max_size=5))
    def same(texts):
        expected = [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        assert coder.ids(texts) == expected
    same()
    text = "one two <|endoftext|> three"
    ids = whole.encode(text, add_special_tokens=False).ids
    assert whole.token_to_id("<|endoftext|>") in ids
    docs = spark.createDataFrame([(1, text), (2, "after")], "doc_id bigint, text string")
    (row,) = packing.best_fit_packing(docs.where("doc_id = 1"), path).collect()
    assert (row.length, row.ids_crc32) == (len(ids) + 1, zlib.crc32(array("I", ids + [2]).tobytes()))
    segments = token_codes.write_token_files(docs, C.work_dir(spark, "added-test"), path)
    starts = {r.doc_id: r.start for r in token_codes.read_token_files(segments).collect()}
    assert starts == {1: 0, 2: len(ids) + 1}


# --- packing -----------------------------------------------------------------------

def test_fullest_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        room = int(rng.integers(1, 40))
        counts = np.zeros(41, np.int64)
        for x in rng.integers(1, 41, int(rng.integers(0, 7))):
            counts[x] += 1
        reach = {0}
        for x in np.repeat(np.arange(41), counts).tolist():
            reach |= {r + x for r in reach if r + x <= room}
        taken = packing.fullest(counts, [int(x) for x in np.flatnonzero(counts)[::-1]], room)
        assert sum(k * n for k, n in taken.items()) == max(reach)
        assert all(counts[k] >= n for k, n in taken.items())


def test_minimum_bin_slack_uses_every_piece():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 300, 1025)
    counts[0] = 0
    bins = packing.minimum_bin_slack(counts, 1024)
    used = np.zeros(1025, np.int64)
    for taken, times in bins:
        assert sum(k * n for k, n in taken.items()) <= 1024 and times > 0
        for k, n in taken.items():
            used[k] += n * times
    assert (used == counts).all()
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert least <= sum(t for _, t in bins) <= least * 1.01 + 1


def test_packing_round_trip(odd):
    got = packing.best_fit_packing(odd, public_tokenizers.path(NAMES[0]), with_ids=True).collect()
    whole = plain(NAMES[0])
    expected = sorted((r.doc_id, whole.encode(r.text or "", add_special_tokens=False).ids + [2])
                      for r in odd.select("doc_id", "text").collect())
    docs, bins = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    seen = []
    for i, pieces in docs.items():
        copies = sum(1 for r in pieces if r.piece == 0)
        pieces = sorted(pieces, key=lambda r: (r.piece, r.sequence_id, r.offset))[::copies]
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 1024 for r in pieces[1:])
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist()
        seen += [(i, ids)] * copies
    assert sorted(seen) == expected
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(len(x) for _, x in expected)
    assert len(bins) <= -(-total // 1024) + 2


def test_sequences_and_empty_packing(odd, empty_docs):
    path = public_tokenizers.path(NAMES[0])
    packed = packing.best_fit_packing(odd.limit(20), path, with_ids=True)
    got = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for s, ids in got.items():
        rows = sorted((r for r in packed.where(F.col("sequence_id") == s).collect()), key=lambda r: r.offset)
        assert ids == b"".join(bytes(r.ids) for r in rows)
        break
    assert packing.best_fit_packing(empty_docs, path).count() == 0


# --- token files -------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 255, 256, 65535, 65536, 2 ** 24, 2 ** 32 - 1]), min_size=1, max_size=1500),
       st.data())
def test_codes_round_trip(values, data):
    ids = np.array(values, "<u4")
    out = io.BytesIO()
    token_codes.write_codes(out, np.array([5, token_codes.NO_ID]), np.array([len(ids), 0]), ids)
    raw = out.getvalue()
    reads = []

    def read(place, size):
        reads.append(size)
        return raw[place:place + size]
    file = token_codes.TokenFile(read)
    assert (file.tokens(0, len(ids)) == ids).all() and len(file) == len(ids)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert (file.tokens(a, b) == ids[a:b]).all()
    reads.clear()
    if a < len(ids):
        assert file.token(a) == ids[a]
        assert sum(reads) <= 4 * (token_codes.RUN // 8 + 16)  # one token reads no block


def test_token_files(spark, odd, empty_docs):
    path = public_tokenizers.path(NAMES[1])
    folder = C.work_dir(spark, "token-test")
    segments = token_codes.write_token_files(odd, folder, path, segment_tokens=2000)
    assert segments.count() > 3
    got = sorted(token_codes.read_token_files(segments).collect(), key=lambda r: r.start)
    whole = plain(NAMES[1])
    rows = sorted(((r.doc_id, whole.encode(r.text or "", add_special_tokens=False).ids + [2])
                   for r in odd.select("doc_id", "text").collect()), key=lambda r: r[0])
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    at = 0
    for r, (_, ids) in zip(got, rows):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)
    first = segments.orderBy("base").first()
    assert token_codes.open_codes(first.path).token(0) == rows[0][1][0]
    none = token_codes.write_token_files(empty_docs, folder + "-empty", path)
    assert token_codes.read_token_files(none).count() == 0
    null = spark.createDataFrame([(None, "b c"), (1, None)], "doc_id bigint, text string")
    got = token_codes.read_token_files(token_codes.write_token_files(null, folder + "-null", path)).collect()
    assert sorted((r.doc_id is None, r.start, r.n_tokens) for r in got) == [(False, 3, 1), (True, 0, 3)]


# --- WARC ------------------------------------------------------------------------------

def test_records_round_trip(tmp):
    body = b"<html>\r\n\r\nWARC/1.1\r\n\x00\xff" * 50
    one = warc._response("a.warc.gz", 0, 5, "http://x/ä\r\ny", warc.DATE, hashlib.sha1(body).hexdigest(), body)
    two = warc._response("a.warc.gz", 1, None, "", warc.DATE, hashlib.sha1(b"").hexdigest(), b"")
    C.write_file(f"{tmp}/a.warc.gz", lambda out: out.write(one + two))
    for chunk in (1 << 20, 7):
        raw = list(warc.read_records(f"{tmp}/a.warc.gz", chunk))
        assert len(raw) == 2
        headers, block = warc.parse(raw[0])
        assert warc.payload_of(headers, block) == body and headers["warc-target-uri"] == "http://x/ä y"
    with pytest.raises(ValueError):
        C.write_file(f"{tmp}/b.warc.gz", lambda out: out.write(one[:-9]))
        list(warc.read_records(f"{tmp}/b.warc.gz"))


def test_revisits(spark, monkeypatch):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (5, None, big), (3, "u3", "small"), (4, "u4", "small"), (6, "u6", None),
            (7, "u7", other), (7, "u7", other), (8, "u8", "x" * 999), (9, "u9", "x" * 999), (None, "u0", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("place", F.lit("extra"))
    path = C.work_dir(spark, "pages-test")
    df.repartition(3).write.parquet(f"{path}/pages.parquet")
    got = warc.op3_warc(spark, path).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert by_id[5] == [("response", None)]
    assert by_id[1] == by_id[2] == by_id[None] == [("revisit", 5)]
    assert sorted(by_id[7]) == [("response", None), ("revisit", 7)]
    assert all(by_id[k] == [("response", None)] for k in (3, 4, 6, 8, 9))
    full = {i: (t or "").encode() for i, _, t in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(full[r.page_id]), hashlib.sha1(full[r.page_id]).hexdigest())


def test_archives_hold_fresh_headers(spark):
    df = spark.createDataFrame([(k, f"http://h/{k}", ("page " * 300).encode()) for k in range(6)],
                               "record_id bigint, uri string, body binary").repartition(2)
    raw = warc.write_archives(df, C.work_dir(spark, "warc-test"))
    done = warc.deduplicate(raw, C.work_dir(spark, "warc-test"))
    records = [warc.parse(r) for a in done.collect() for r in warc.read_records(a.archive)]
    kinds = [h["warc-type"] for h, _ in records]
    assert kinds.count("response") == 1 and kinds.count("revisit") == 5
    (kept,) = [h for h, _ in records if h["warc-type"] == "response"]
    for h, block in records:
        if h["warc-type"] == "revisit":
            assert h["warc-refers-to"] == kept["warc-record-id"] and h["warc-profile"] == warc.PROFILE
            assert h["warc-refers-to-target-uri"] == kept["warc-target-uri"] == "http://h/5"
            assert warc.payload_of(h, block) == b"" and h["warc-record-id"] != kept["warc-record-id"]
    assert warc.read_headers(done).where("record_type = 'response'").count() == 1


def test_no_pages(spark):
    df = spark.createDataFrame([], "record_id bigint, uri string, body binary")
    done = warc.deduplicate(warc.write_archives(df, C.work_dir(spark, "warc-none")), C.work_dir(spark, "warc-none"))
    assert warc.read_headers(done).count() == 0


def test_bytes_that_are_not_utf8_are_replaced(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    from vitrine.llm import packing, token_codes, warc
    from vitrine.llm import common as C
    df = spark.sql("select 1L as doc_id, cast(unhex('6F6E6520FF74776F') as string) as text union all select 2L, 'fine'")
    text = b"one \xfftwo".decode("utf-8", "replace")
    for name, run in (("byte_bpe_50k.json", lambda p: packing.pieces(df, p, with_ids=True)),):
        path = public_tokenizers.path(name)
        got = {r.doc_id: bytes(r.ids) for r in run(path).collect()}
        ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(got[1], "<u4").tolist() == ids
    path = public_tokenizers.path("word_bpe_49k.json")
    segments = token_codes.write_token_files(df, C.work_dir(spark, "t"), path)
    rows = {r.doc_id: r.n_tokens for r in token_codes.read_token_files(segments).collect()}
    assert rows[1] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids) + 1
    pages = spark.sql("select 1L as page_id, cast(unhex('687474703A2F2FFF') as string) as url, cast(unhex('FF41') as string) as html")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    row = warc.op3_warc(spark, str(tmp_path)).first()
    assert row.payload_bytes == 2 and row.payload_digest == __import__("hashlib").sha1(b"\xffA").hexdigest()
