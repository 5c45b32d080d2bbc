"""Dedup of strings of ``LENGTH`` bytes by prefix-free parsing, bucket by bucket.

Every byte that a string of ``LENGTH`` bytes covers which also starts in a document
with a smaller id is removed.

Anchors: a rolling hash of ``TRIGGER`` bytes runs over the text; a place is an
anchor if its hash is the smallest of some ``LENGTH - TRIGGER + 1`` neighbouring
places. So every string of ``LENGTH`` bytes has one anchor of its own (the leftmost
smallest hash inside it), which depends on nothing but the string: the string is an
end of the phrase before its anchor followed by a beginning of the parse from it on.

Plan
----
1. ``mapInArrow``: the anchors of every text, dealt to buckets by hash; a bucket
   finds those that occur in two or more documents. What a block of documents
   can decide itself it does (an anchor that many documents share reaches its
   bucket once per block). This is a filter.
2. Texts and their shared anchors are joined; the bytes before and from each shared
   anchor go to the bucket of the anchor. Equal ones of a block go once, under their
   smallest document; the others are removed there and then, once their bytes have
   been compared.
3. In a bucket the text from each anchor is parsed: where the hash of the last
   ``CUT`` bytes of a phrase is zero modulo ``DENSITY`` the phrase ends. That depends on
   the phrase alone, so no phrase is the beginning of another one. The distinct phrases
   are the bucket's dictionary; sorted, they have ranks, and each text becomes a
   sequence of ranks, the parse. Sorting the sequences sorts the texts, since ranks
   keep the order of prefix-free phrases. The dictionary of distinct phrase ends (the
   bytes before the anchors) is sorted from the right.
4. Both orders, each with the common bytes of neighbours, combine into the corpus
   order of the suffixes, cut at ``LENGTH`` bytes: strings with the same distance to the
   anchor are equal if they are in one run of either order. Runs give the smallest
   document.
5. Removed intervals go back per document, are merged and cut out of the text
   (the shuffle of the texts for step 2 is used again).

The dictionary and the parse are those of a bucket (about ``REGION_BYTES`` of text
around shared anchors), never of the whole corpus: what is asked for is which strings
are equal, and equal strings meet in one bucket.

Cases: null texts are empty; texts shorter than ``LENGTH`` keep all bytes; a row
without ``doc_id`` keeps all and removes none elsewhere; rows with the same
``doc_id`` do not remove each other's bytes and are judged one by one; an empty
table gives an empty result; other columns are ignored. Long texts are worked
through in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import packets as P

LENGTH = 50
TRIGGER = 20
WINDOW = LENGTH - TRIGGER + 1
AHEAD = WINDOW - 1  # bytes a phrase end has at most
BLOCK_BYTES = (1 << 20) - 8192
CUT_BYTES = 1 << 22
BUCKET_BYTES = 20 << 20  # of text, per bucket of triggers
REGION_BYTES = 10 << 20  # of text, per bucket of strings
CUT, DENSITY = 4, 16  # bytes whose hash ends a phrase, and one in how many does
SEED = C.SEED
TRIGGERS = "bucket int, kind int, ids binary, keys binary, counts binary, gaps binary, wide binary, hashes binary"
REGIONS = ("bucket int, kind int, ids binary, keys binary, counts binary, spans binary, places binary, "
           "before binary, after binary, bytes binary")
MARKS = "doc_id bigint, doc_key bigint, marks binary"


# --- parsing -----------------------------------------------------------------------

class Segments:
    """Texts laid end to end, a long one cut to overlapping segments: ``data``,
    and per segment its row, its first byte in the row, and its bounds."""

    def __init__(self, rows: list[int], firsts: list[int], parts: list[np.ndarray]) -> None:
        self.row, self.first = np.array(rows, np.int64), np.array(firsts, np.int64)
        self.bound = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        self.data = np.concatenate(parts)


def segments(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[Segments]:
    """Blocks of at most about ``limit`` bytes; strings start in one segment only."""
    rows, firsts, parts, size = [], [], [], 0
    for row in range(len(offsets) - 1):
        n = int(offsets[row + 1] - offsets[row])
        for first in range(0, max(n - LENGTH + 1, 0), limit // 2):
            part = data[offsets[row] + first:offsets[row] + min(n, first + limit // 2 + LENGTH - 1)]
            if parts and size + len(part) > limit:
                yield Segments(rows, firsts, parts)
                rows, firsts, parts, size = [], [], [], 0
            rows.append(row)
            firsts.append(first)
            parts.append(part)
            size += len(part)
    if parts:
        yield Segments(rows, firsts, parts)


def triggers(seg: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per trigger its place in the block, the first and last start of the
    strings it belongs to, its segment and its hash."""
    n = len(seg.data)
    prefix = C.prefix_hash(C.BYTE_VALUES[seg.data], SEED)
    _, inverse = C.powers(SEED, len(prefix))
    m = n - TRIGGER + 1
    h = C.mix64((prefix[TRIGGER:] - prefix[:m]) * inverse[:m])
    del prefix
    low = np.uint64((1 << 21) - 1)  # places in a block; ties go to the left
    order = (h & ~low) | np.arange(m, dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    if width < WINDOW:
        order = np.minimum(order[:-(WINDOW - width)], order[WINDOW - width:])
    own = (order & low).astype(np.int64)  # trigger of the string that starts here
    lengths = np.diff(seg.bound)
    inside = np.ones(n, bool)
    for back in range(1, LENGTH):
        inside[seg.bound[1:][lengths >= back] - back] = False
    start = np.flatnonzero(inside[:len(own)])
    own = own[start]
    edge = np.ones(len(own), bool)
    edge[1:] = own[1:] != own[:-1]
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(own)) - 1
    place, lo, hi = own[first], start[first], start[last]
    return place, lo, hi, np.searchsorted(seg.bound, place, side="right") - 1, h[place]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, batch.column("doc_key").to_numpy(zero_copy_only=False).astype(np.int64).astype("<u4")


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (C.mix64(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(deal: np.ndarray, chosen: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    chosen = chosen[np.argsort(deal[chosen], kind="stable")]
    cuts = np.searchsorted(deal[chosen], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b + 1] > cuts[b]:
            yield b, chosen[cuts[b]:cuts[b + 1]]


def _least_of(order: np.ndarray, new: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Smallest owner of each run of ``order`` (``new`` marks its first), per item."""
    out = np.empty(len(order), owner.dtype)
    out[order] = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


# --- shared triggers -----------------------------------------------------------------

def _trigger_packets(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [
        (n, pa.binary()) for n in ("ids", "keys", "counts", "gaps", "wide", "hashes")])

    def packet(bucket, kind, chosen, rows, places, h, ids, keys):
        docs, first = P.documents_of(rows[chosen], ids, keys)
        gaps, wide = P.pack_positions(places[chosen], first, "<u2")
        return {"bucket": bucket, "kind": kind, **docs, "gaps": gaps, "wide": wide,
                "hashes": (h[chosen] >> np.uint64(32)).astype("<u4").tobytes() if kind == 0 else b""}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.merged_batches(batches, "body", BLOCK_BYTES):
            ids, keys = _columns(batch)
            for seg in segments(*C.binary_column(batch.column("body"))):
                place, _, _, part, h = triggers(seg)
                rows = seg.row[part]
                places = place - seg.bound[part] + seg.first[part]
                order = np.argsort(h)
                new = np.ones(len(h), bool)
                new[1:] = h[order][1:] != h[order][:-1]
                owner = ids[rows]
                least = _least_of(order, new, owner)
                shared = -_least_of(order, new, -owner) > least
                sent = ~shared
                sent[order[new]] = True  # of shared ones one speaks for all
                deal = _bucket_of(h, buckets)
                out = [packet(b, 0, c, rows, places, h, ids, keys)
                       for b, c in _by_bucket(deal, np.flatnonzero(sent), buckets)]
                here = np.flatnonzero(shared)
                if len(here):
                    out.append(packet(int(ids[seg.row[0]]) % buckets, 1, here, rows, places, h, ids, keys))
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _shared_triggers(parts: int):
    def run(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column("counts")]
        places = np.concatenate([P.unpack_positions(g.as_py(), w.as_py(), c, "<u2") for c, g, w in zip(
            counts, table.column("gaps"), table.column("wide"))]).astype(np.int32)
        sizes = [int(c.sum()) for c in counts]
        counts = np.concatenate(counts)
        row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        ids, keys = P.join_column(table, "ids", "<i8"), P.join_column(table, "keys", "<u4")
        marked = np.repeat(np.array(table.column("kind").to_pylist()) == 1, sizes)
        asked = np.flatnonzero(~marked)
        h = P.join_column(table, "hashes", "<u4")
        order = np.argsort(h)
        h = h[order]
        equal = np.zeros(len(h) + 1, bool)
        equal[1:-1] = h[1:] == h[:-1]
        again = np.flatnonzero(equal[1:] | equal[:-1])
        if len(again):
            spot = asked[order[again]]
            owner = ids[row[spot]]
            first = np.flatnonzero(~equal[again])
            run_of = np.cumsum(~equal[again]) - 1
            apart = np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first)
            marked[spot[apart[run_of]]] = True
        hit = np.flatnonzero(marked)
        return P.to_parts(row[hit], places[hit], ids, keys, parts)
    return run


# --- strings around shared triggers ----------------------------------------------------

def _region_packets(buckets: int):
    names = ("ids", "keys", "counts", "spans", "places", "before", "after", "bytes")
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [(n, pa.binary()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(batch.column("marks").is_valid())
            for block in C.by_bytes(iter([batch]), "body", BLOCK_BYTES):
                yield from regions(block, packer)

    def regions(block: pa.RecordBatch, packer: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
        ids, keys = _columns(block)
        marks = [np.frombuffer(x.as_py(), "<i4") for x in block.column("marks")]
        for seg in segments(*C.binary_column(block.column("body"))):
            place, lo, hi, part, h = triggers(seg)
            rows, shift = seg.row[part], seg.first[part] - seg.bound[part]
            # shared triggers of this block, as places in the block
            wanted = [marks[r] - f + b for r, f, b in zip(seg.row, seg.first, seg.bound)]
            wanted = np.concatenate([w[(w >= b) & (w < e)] for w, b, e in zip(wanted, seg.bound, seg.bound[1:])])
            flag = np.zeros(len(seg.data), bool)
            flag[wanted] = True
            keep = np.flatnonzero(flag[place])
            if not len(keep):
                continue
            place, lo, hi, rows, h, shift = (x[keep] for x in (place, lo, hi, rows, h, shift))
            end = hi + LENGTH
            size = end - lo
            prefix = C.prefix_hash(C.BYTE_VALUES[seg.data], SEED)
            whole = C.mix64(C.span_hash(prefix, lo, end, SEED) + ((place - lo) * 64 + size).astype(np.uint64))
            owner = ids[rows]
            order = np.lexsort((owner, whole))
            new = np.ones(len(whole), bool)
            new[1:] = whole[order][1:] != whole[order][:-1]
            speaker = np.empty(len(whole), np.int64)  # the smallest document's, for all of one hash
            speaker[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            gone = owner > owner[speaker]
            some = np.flatnonzero(gone)
            gone[some] = _same_bytes(seg.data, lo[some], lo[speaker[some]], size[some], size[speaker[some]])
            gone[some] &= (place - lo)[some] == (place - lo)[speaker[some]]
            deal, out = _bucket_of(h, buckets), []
            here = np.flatnonzero(gone)
            if len(here):  # a smaller document of the block has the same: all its strings go
                spans = np.stack([lo[here] + shift[here], end[here] + shift[here]], axis=1).astype("<i4")
                out.append({"bucket": int(ids[rows[0]]) % buckets, "kind": 1, "spans": spans.tobytes(),
                            "places": b"", "before": b"", "after": b"", "bytes": b"",
                            **P.documents_of(rows[here], ids, keys)[0]})
            for b, c in _by_bucket(deal, np.flatnonzero(~gone), buckets):
                total = int(size[c].sum())
                at = np.repeat(lo[c] - (np.cumsum(size[c]) - size[c]), size[c]) + np.arange(total)
                out.append({"bucket": b, "kind": 0, "spans": b"",
                            "places": (place[c] + shift[c]).astype("<i4").tobytes(),
                            "before": (place[c] - lo[c]).astype(np.uint8).tobytes(),
                            "after": (end[c] - place[c]).astype(np.uint8).tobytes(),
                            "bytes": packer.compress(seg.data[at].tobytes()), **P.documents_of(rows[c], ids, keys)[0]})
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``one`` are the ``other`` bytes at ``two``."""
    same = size == other
    for step in range(int(size.max()) if len(size) else 0):
        here = np.flatnonzero(same & (step < size))
        same[here] = data[one[here] + step] == data[two[here] + step]
    return same


def _sorted_rows(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows."""
    words = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view(">u8")
    return np.lexsort(words.T[::-1])


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common first bytes of each row with the one before it in ``order``."""
    common = np.zeros(len(rows), np.uint8)
    for at in range(1, len(rows), 1 << 15):
        one, two = rows[order[at:at + (1 << 15)]], rows[order[at - 1:at - 1 + (1 << 15)]]
        differ = one != two[:len(one)]
        common[at:at + (1 << 15)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return common


def _phrases(rows: np.ndarray) -> np.ndarray:
    """Where the phrases of each row end: entry (i, j) for one that ends with byte j."""
    n, width = rows.shape
    ends = np.zeros((n, width), bool)
    begun = np.zeros(n, np.int16)  # first byte of the phrase under way
    with np.errstate(over="ignore"):
        for j in range(CUT - 1, width):
            h = np.zeros(n, np.uint32)
            for step in range(CUT):
                h = h * np.uint32(0x01000193) ^ rows[:, j - CUT + 1 + step]
            h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            cut = (h >> np.uint32(13)) % np.uint32(DENSITY) == 0
            cut &= j + 1 - begun >= CUT
            ends[:, j] = cut
            begun[cut] = j + 1
    ends[:, -1] = True
    return ends


def _dictionary(rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The parse of the rows: per phrase its row and its rank among the distinct
    phrases of all rows, and the size of that dictionary."""
    width = rows.shape[1]
    flat = rows.ravel()
    stop = (np.flatnonzero(ends.ravel()) + 1).astype(np.int32)
    start = np.concatenate((np.zeros(1, np.int32), stop[:-1]))
    size = (stop - start).astype(np.uint8)
    lots = range(0, len(start), 1 << 18)
    # hashes find the distinct phrases, bytes decide
    h = np.empty(len(start), np.uint64)
    for at in lots:
        cut = slice(at, at + (1 << 18))
        lo, hi = int(start[cut][0]), int(stop[cut][-1])
        prefix = C.prefix_hash(C.BYTE_VALUES[flat[lo:hi]], SEED)
        h[cut] = C.mix64(C.span_hash(prefix, start[cut] - lo, stop[cut] - lo, SEED) + size[cut].astype(np.uint64))
    _, first, name = np.unique(h, return_index=True, return_inverse=True)
    del h
    first, name = first.astype(np.int32), name.astype(np.int32)
    for at in lots:
        cut = slice(at, at + (1 << 18))
        like = first[name[cut]]
        odd = np.flatnonzero(~_same_bytes(flat, start[cut], start[like], size[cut], size[like]))
        if len(odd):  # different phrases of one hash: each such occurrence is its own entry
            name[at + odd] = len(first) + np.arange(len(odd))
            first = np.concatenate((first, (at + odd).astype(np.int32)))
    longest = int(size.max())
    entries = np.zeros((len(first), longest), np.uint8)
    for step in range(longest):
        here = np.flatnonzero(size[first] > step)
        entries[here, step] = flat[start[first[here]] + step]
    order = _sorted_rows(entries)
    rank = np.empty(len(first), np.int32)
    # equal entries (of one hash or not) have one rank
    rank[order] = np.cumsum(_common(entries, order) < longest)
    return (stop - 1) // width, rank[name], len(first)


def _parse_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows by their sequences of phrase ranks."""
    row, rank, _ = _dictionary(rows, _phrases(rows))
    begin = np.searchsorted(row, np.arange(len(rows))).astype(np.int32)
    place = np.arange(len(row), dtype=np.int32) - begin[row]
    parse = np.zeros((len(rows), int(place.max()) + 1), np.int32)
    parse[row, place] = rank
    return np.lexsort(parse.T[::-1])


def _end_order(rows: np.ndarray) -> np.ndarray:
    """Order of phrase ends (byte rows from the right), by the distinct ones."""
    flat = C.BYTE_VALUES[rows.ravel()]
    width = rows.shape[1]
    h = np.empty(len(rows), np.uint64)
    for at in range(0, len(rows), 1 << 14):
        n = min(1 << 14, len(rows) - at)
        prefix = C.prefix_hash(flat[at * width:(at + n) * width], SEED)
        start = np.arange(n) * width
        h[at:at + n] = C.mix64(C.span_hash(prefix, start, start + width, SEED))
    _, first, name = np.unique(h, return_index=True, return_inverse=True)
    if not (rows == rows[first[name]]).all():  # two ends of one hash
        return _sorted_rows(rows)
    order = _sorted_rows(rows[first])
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    return np.argsort(rank[name], kind="stable")


def removed_strings(owner: np.ndarray, before: np.ndarray, after: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which strings also start in a smaller document: entry (i, o) for the
    string of entry i that starts ``o`` bytes before its trigger."""
    n = len(owner)
    size = before + after
    place = (np.cumsum(size) - size + before).astype(np.int32)
    ahead, back = np.arange(LENGTH, dtype=np.int32), np.arange(1, AHEAD + 1, dtype=np.int32)

    def filled(step: np.ndarray, sign: int, room: np.ndarray) -> np.ndarray:
        """The bytes at ``step`` from each trigger, zero beyond its ``room``."""
        rows = np.zeros((n, len(step)), np.uint8)
        for at in range(0, n, 1 << 15):
            cut = slice(at, at + (1 << 15))
            spot = np.clip(place[cut, None] + sign * step, 0, len(data) - 1)
            rows[cut] = data[spot] * (step - (sign < 0) < room[cut, None])
        return rows
    rows = filled(ahead, 1, after)
    by_right = _parse_order(rows)
    right_common = _common(rows, by_right)
    rows = filled(back, -1, before)
    by_left = _end_order(rows)
    left_common = _common(rows, by_left)
    del rows
    out = np.zeros((n, AHEAD + 1), bool)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(AHEAD + 1):
        here = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(here) < 2:
            continue
        a[by_right] = np.cumsum(right_common < LENGTH - o)  # runs that share LENGTH - o bytes from the trigger on
        b[by_left] = np.cumsum(left_common < o) if o else 0  # and o bytes before it
        key = a[here] * (n + 1) + b[here]
        order = np.argsort(key)
        new = np.ones(len(here), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        out[here, o] = owner[here] > _least_of(order, new, owner[here])
    return out


def _removed_spans(parts: int):
    def run(table: pa.Table) -> pa.Table:
        ids, keys = P.join_column(table, "ids", "<i8"), P.join_column(table, "keys", "<u4")
        counts = P.join_column(table, "counts", "<u4").astype(np.int64)
        n_docs = [len(x.as_py()) // 4 for x in table.column("counts")]
        known = np.repeat(np.array(table.column("kind").to_pylist()) == 1, n_docs)
        row = np.arange(len(counts), dtype=np.int32)
        asked = np.repeat(row[~known], counts[~known])
        places = P.join_column(table, "places", "<i4")
        before, after = P.join_column(table, "before", "u1").astype(np.int64), P.join_column(table, "after", "u1").astype(np.int64)
        unpack = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"".join(unpack.decompress(x.as_py()) for x in table.column("bytes") if len(x.as_py())), "u1")
        spans, owners = [P.join_column(table, "spans", "<i4").reshape(-1, 2)], [np.repeat(row[known], counts[known])]
        if len(asked) > 1:
            gone = removed_strings(ids[asked], before, after, data)
            # runs of neighbouring strings: from o = last (leftmost start) to o = first
            edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            i, first = np.nonzero(edge == 1)
            _, stop = np.nonzero(edge == -1)
            spans.append(np.stack([places[i] - (stop - 1), places[i] - first + LENGTH], axis=1).astype(np.int32))
            owners.append(asked[i])
        spans, owners = np.concatenate(spans), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return P.to_parts(owners[order], spans[order], ids, keys, parts)
    return run


# --- the operator ----------------------------------------------------------------------

def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that (n, 2) spans cover."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    return spans[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]


def _cut(digest: bool):
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
             ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())),
             ("kept", pa.string() if digest else pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.by_bytes(batches, "body", CUT_BYTES):
            out = {k: [] for k, _ in kinds}
            for doc, body, marks in zip(batch.column("doc_id"), batch.column("body"), batch.column("marks")):
                body, marks = body.as_py(), marks.as_py()
                starts = ends = np.zeros(0, np.int64)
                kept = body
                if marks:
                    starts, ends = merged(np.frombuffer(marks, "<i4").reshape(-1, 2).astype(np.int64))
                    kept = b"".join(body[s:e] for s, e in zip([0, *ends.tolist()], [*starts.tolist(), len(body)]))
                row = (doc.as_py(), len(body), len(body) - len(kept), len(starts), starts, ends,
                       hashlib.sha256(kept).hexdigest() if digest else kept)
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds], [k for k, _ in kinds])
    return run


def suffix_dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, span_starts, span_ends, kept) of
    every row: byte positions of the maximal removed runs (ends exclusive) and
    the bytes left, or with ``digest`` their SHA-256."""
    size = C.total_bytes(docs)
    buckets, regions = C.parts_for(size, BUCKET_BYTES), C.parts_for(size, REGION_BYTES)
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("doc_key"),
                        C.text_bytes().alias("body"))
    named = whole.where(F.col("doc_id").isNotNull() & (F.octet_length("body") >= LENGTH))

    def with_marks(marks: DataFrame) -> DataFrame:
        marks = marks.withColumnsRenamed({"doc_id": "__id", "doc_key": "__key"})
        return whole.join(marks, (F.col("doc_id") == F.col("__id")) & (F.col("doc_key") == F.col("__key")),
                          "left").select("doc_id", "doc_key", "body", "marks")

    found = named.mapInArrow(_trigger_packets(buckets), TRIGGERS).groupBy("bucket").applyInArrow(
        _shared_triggers(buckets), P.PARTS).groupBy("part").applyInArrow(P.gather(1), MARKS)
    spans = with_marks(found).mapInArrow(_region_packets(regions), REGIONS).groupBy("bucket").applyInArrow(
        _removed_spans(buckets), P.PARTS).groupBy("part").applyInArrow(P.gather(2), MARKS)
    schema = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, span_starts array<bigint>, "
              f"span_ends array<bigint>, kept {'string' if digest else 'binary'}")
    return with_marks(spans).mapInArrow(_cut(digest), schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(C.read_table(spark, sf_dir, "documents"), digest=True)
    return C.few_files(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256")))
