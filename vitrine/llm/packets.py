"""Packed rows between documents and hash buckets.

Positions in documents travel from tasks to buckets and back in packed rows: one
per block of documents and bucket, then one per bucket and part of the
documents. What is packed grows with the positions, not with the number of
(document, bucket) pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vitrine.llm import common as C

PARTS = "part int, ids binary, keys binary, counts binary, values binary"


def pack_positions(positions: np.ndarray, first: np.ndarray, kind: str) -> tuple[bytes, bytes]:
    """Positions rising within each document (``first``: index of each
    document's first one) as narrow gaps; the largest value of the narrow type
    points to the wide list."""
    most = np.iinfo(kind).max
    gap = np.diff(positions, prepend=0)
    gap[first] = positions[first]
    return np.minimum(gap, most).astype(kind).tobytes(), gap[gap >= most].astype("<i4").tobytes()


def unpack_positions(gaps: bytes, wide: bytes, counts: np.ndarray, kind: str) -> np.ndarray:
    gap = np.frombuffer(gaps, kind).astype(np.int64)
    gap[gap == np.iinfo(kind).max] = np.frombuffer(wide, "<i4")
    total = np.cumsum(gap)
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - gap[first], counts)


def documents_of(rows: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[dict, np.ndarray]:
    """Packed ids, keys and counts of the documents in ``rows`` (rising), and
    each one's first index."""
    docs, first, counts = np.unique(rows, return_index=True, return_counts=True)
    return {"ids": ids[docs].tobytes(), "keys": keys[docs].astype("<u4").tobytes(),
            "counts": counts.astype("<u4").tobytes()}, first


def join_column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def to_parts(rows: np.ndarray, values: np.ndarray, ids: np.ndarray, keys: np.ndarray, parts: int) -> pa.Table:
    """Values (n, or n x m, of documents ``rows``) as one row per part of the
    documents (dealt by id)."""
    docs, counts = np.unique(rows, return_counts=True)
    part = (C.mix64(ids[docs].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    entry = np.argsort(np.repeat(part, counts), kind="stable")
    docs, counts, part, values = docs[order], counts[order], part[order], values[entry]
    names, first = np.unique(part, return_index=True)
    ends = np.append(first[1:], len(part))
    at = np.concatenate(([0], np.cumsum(counts)))
    out = {"part": names, "ids": [], "keys": [], "counts": [], "values": []}
    for s, e in zip(first, ends):
        out["ids"].append(ids[docs[s:e]].tobytes())
        out["keys"].append(keys[docs[s:e]].astype("<u4").tobytes())
        out["counts"].append(counts[s:e].astype("<u4").tobytes())
        out["values"].append(values[at[s]:at[e]].astype("<i4").tobytes())
    kinds = [pa.int32()] + [pa.binary()] * 4
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


def gather(width: int):
    """One part: all values (``width`` int32 each) of a document in one row
    (doc_id, doc_key, marks)."""
    def run(table: pa.Table) -> pa.Table:
        ids, keys = join_column(table, "ids", "<i8"), join_column(table, "keys", "<u4").astype(np.int64)
        counts = join_column(table, "counts", "<u4").astype(np.int64)
        values = join_column(table, "values", "<i4").reshape(-1, width)
        order = np.lexsort((keys, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        entry = np.repeat(group, counts)
        ends = np.concatenate(([0], np.cumsum(np.bincount(entry, minlength=int(new.sum()))))) * 4 * width
        marks = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [
            None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values[np.argsort(entry, kind="stable")])])
        return pa.table({"doc_id": ids[order][new], "doc_key": keys[order][new], "marks": marks.cast(pa.binary())})
    return run
