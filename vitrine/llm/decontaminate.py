"""Benchmark decontamination by greedy string tiling.

Plan
----
1. The benchmark becomes a written table of items: their words as hashes and their
   seeds, the hashes of every run of ``MIN_MATCH`` words. Nothing of it passes through
   the driver but a bit map of the seeds (two bits a seed, ``MAP_BITS`` bits at most).
2. A seed that many items share is no candidate where it cannot matter: of an item's
   seeds, those that the most items share are left out as long as the words they cover
   stay below the threshold, since a document that shares only those cannot reach it.
3. One map-only pass over whole texts looks every run up in the bit map; texts with a
   hit are written as words and seeds, the others send nothing.
4. Texts and items are joined on seeds (equi-join; a seed that very many documents
   share is salted), each pair counts once, and a text meets its items in lots of
   about ``LOT`` items.
5. For each pair the tiling repeatedly marks the longest common runs of words not
   marked yet (all of that length that do not overlap), found by Karp-Rabin hashes of
   falling length, until none has ``MIN_MATCH`` words. So an item whose sentences were
   reordered is covered by several tiles. Coverage is the share of the item's words
   that are marked.

The plan is the same whatever the size of the benchmark.

Words are lower-cased (A-Z) runs of characters other than white space and
punctuation; in scripts written without spaces (``UNSPACED``: Han, kana, Thai, Lao,
Khmer, Burmese and others) each character is a word.

Cases: null and empty texts match nothing, on either side; items of fewer than
``MIN_MATCH`` words are taken with ``short_items`` (both queries do so), with all
their words as the seed, so a document leaks them only by holding them verbatim,
an item of one word by holding that word; repeated documents are
reported row by row, repeated items once per row; of equally long runs the one first
in the item is marked first, at its first free place in the text; very long texts are
looked up whole, a text at a time; an empty benchmark gives no rows; extra columns are
ignored unless asked for by ``carry``.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C

MIN_MATCH = 5
THRESHOLD = 0.5
TEXT_BYTES = 1 << 21
SEED = C.SEED
MAP_BITS = 28  # at most: 32 MB
SHARED_BY = 16  # items: seeds of fewer are always candidates
SALTS = 16
LOT = 64
FOUND = "doc_id bigint, item_id bigint, item_words bigint, matched_words bigint, tiles bigint, coverage double"

IS_BREAK = C.IS_SPACE.copy()
IS_BREAK[list(string.punctuation.encode())] = True
_LOWER = np.arange(256)
_LOWER[ord("A"):ord("Z") + 1] += 32
LOWER_VALUES = C.BYTE_VALUES[_LOWER]
#: first and last characters of scripts that put no space between words
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
            (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF),
            (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F),
            (0x20000, 0x3FFFF))
BREAK, SINGLE = 1, 2
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """BREAK, SINGLE (a word of its own) or 0 per character number."""
    if not _KINDS:
        table = np.zeros(0x200000, np.uint8)
        for first, last in UNSPACED:
            table[first:last + 1] = SINGLE
        for c in range(0x80, 0x20000):
            if unicodedata.category(chr(c))[0] in "PZ":
                table[c] = BREAK
        table[[0x85, 0x200B, 0xFEFF]] = BREAK  # next line, zero-width spaces
        table[[0xFEE0 + ord(c) for c in string.punctuation]] = BREAK  # full-width forms
        _KINDS.append(table)
    return _KINDS[0]


def _refine(data: np.ndarray, inside: np.ndarray, edge: np.ndarray) -> None:
    """Words of characters beyond ASCII; bytes that are not UTF-8 stay in words."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return
    byte = data[lead].astype(np.int64)
    size = 2 + (byte >= 0xE0) + (byte >= 0xF0)
    code = byte & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    good = lead + size <= len(data)
    for k in range(1, 4):
        more = size > k
        at = np.minimum(lead + k, len(data) - 1)
        good &= ~more | ((data[at] & 0xC0 == 0x80) & ~edge[at])
        code = np.where(more, code << 6 | data[at] & 0x3F, code)
    kind = np.where(good, kinds()[code], 0)
    for k in range(4):
        inside[lead[(kind == BREAK) & (size > k)] + k] = False
    single = kind == SINGLE
    edge[lead[single]] = True
    edge[lead[single] + size[single]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and each text's first word."""
    start, end, first = C.word_bounds(data, offsets, IS_BREAK, _refine)
    return C.word_hashes(data, start, end, values=LOWER_VALUES), first


def _free_runs(prefix: np.ndarray, used: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of ``length`` words without a marked one."""
    n = len(used) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marks = np.concatenate(([0], np.cumsum(used)))
    start = np.flatnonzero(marks[length:] == marks[:n])
    return start, C.mix64(C.span_hash(prefix, start, start + length, SEED))


def tile(text: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (place in text, place in item, length)."""
    text_prefix, item_prefix = C.prefix_hash(text, SEED), C.prefix_hash(item, SEED)
    text_used, item_used = np.zeros(len(text), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(text), len(item))

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, ha = _free_runs(text_prefix, text_used, length)
        b, hb = _free_runs(item_prefix, item_used, length)
        b_hit = np.isin(hb, ha)
        b, hb = b[b_hit], hb[b_hit]
        a_hit = np.isin(ha, hb)
        return a[a_hit], ha[a_hit], b, hb

    while top >= least:
        low, high, found = least, top, None
        while low <= high:  # a common run of some length has common runs of all shorter ones
            middle = (low + high) // 2
            got = common(middle)
            if len(got[2]):
                low, found, best = middle + 1, got, middle
            else:
                high = middle - 1
        if found is None:
            break
        places: dict[int, list[int]] = {}
        for a, h in zip(found[0].tolist(), found[1].tolist()):
            places.setdefault(h, []).append(a)
        next_place = dict.fromkeys(places, 0)
        for b, h in zip(found[2].tolist(), found[3].tolist()):
            if item_used[b:b + best].any():
                continue
            options = places[h]
            while next_place[h] < len(options):
                a = options[next_place[h]]
                next_place[h] += 1
                if not text_used[a:a + best].any() and (text[a:a + best] == item[b:b + best]).all():
                    text_used[a:a + best] = True
                    item_used[b:b + best] = True
                    tiles.append((a, b, best))
                    break
        top = best if best < top else best - 1
        if top == best and not any(t[2] == best for t in tiles):
            top -= 1
    return tiles


# --- the benchmark ------------------------------------------------------------------

def _items(short_items: bool):
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("width", pa.int32()), ("words", pa.binary()),
                        ("seeds", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.by_bytes(batches, "body", TEXT_BYTES):
            words, first = words_of(*C.binary_column(batch.column("body")))
            out = []
            for k, (s, e) in enumerate(zip(first[:-1], first[1:])):
                width = min(MIN_MATCH, int(e - s))
                if width == MIN_MATCH or width and short_items:
                    own = words[s:e]
                    out.append({"item": batch.column("item")[k].as_py(), "item_id": batch.column("item_id")[k].as_py(),
                                "width": width, "words": own.tobytes(),
                                "seeds": C.window_hashes(own, width, SEED).view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def item_table(benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """(item, item_id, width, words, seeds), written once; ``item`` numbers the rows."""
    rows = C.through_table(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), C.text_bytes().alias("body"),
                                            F.monotonically_increasing_id().alias("item")), "benchmark")
    return C.through_table(rows.mapInArrow(
        _items(short_items), "item bigint, item_id bigint, width int, words binary, seeds array<bigint>"), "items")


def _spared(threshold: float):
    """Of each item the shared seeds that cannot carry it over the threshold alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, seeds = [], []
            for row in batch.to_pylist():
                need = threshold * row["n_words"]
                at = np.array(row["seeds"], np.int64)
                covered = np.zeros(row["n_words"], bool)
                for shared in sorted(row["shared"], key=lambda x: (-x["n"], x["seed"])):
                    for p in np.flatnonzero(at == shared["seed"]).tolist():
                        covered[p:p + row["width"]] = True
                    if covered.sum() >= need:
                        break
                    items.append(row["item"])
                    seeds.append(shared["seed"])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(seeds, pa.int64())], ["item", "seed"])
    return run


def candidate_seeds(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, seed): enough of each item's seeds that a document that covers it to
    the threshold shares one of them."""
    pairs = items.select("item", F.explode(F.array_distinct("seeds")).alias("seed"))
    shared = pairs.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > SHARED_BY)
    hot = pairs.join(shared, "seed").groupBy("item").agg(F.collect_list(F.struct("seed", "n")).alias("shared"))
    rated = items.join(hot, "item").select("item", "width", "seeds", "shared",
                                           (F.octet_length("words") / 8).cast("int").alias("n_words"))
    spared = rated.mapInArrow(_spared(threshold), "item bigint, seed bigint")
    return C.through_table(pairs.join(spared, ["item", "seed"], "left_anti"), "seeds")


def bit_map(seeds: DataFrame) -> np.ndarray:
    """Bits of two places of each seed, as many as fit ``MAP_BITS``; the driver gets
    the words of the map that hold a bit, 32 MB at most."""
    n = seeds.select(F.approx_count_distinct("seed")).first()[0]
    bits = min(MAP_BITS, max(20, int(1024 * n).bit_length()))  # up to 2^18 seeds one run in 250,000 hits by chance
    mask = F.lit((1 << bits) - 1)
    places = F.array(F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 32).bitwiseAND(mask))
    words = seeds.select(F.explode(places).alias("p")).groupBy((F.shiftright("p", 5)).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("b")).toArrow()
    found = np.zeros(1 << (bits - 5), np.uint32)
    found[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return found


def _in_map(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(table) * 32 - 1)

    def bit(place: np.ndarray) -> np.ndarray:
        return table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32) & 1 > 0
    first = np.flatnonzero(bit(h & mask))
    return first[bit(h[first] >> np.uint64(32) & mask)]


# --- texts ---------------------------------------------------------------------------

def _hits(table: np.ndarray, widths: list[int], carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.by_bytes(batches, "body", TEXT_BYTES):
            words, first = words_of(*C.binary_column(batch.column("body")))
            docs, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for width in widths:
                h = C.window_hashes(words, width, SEED)
                place = _in_map(table, h)
                doc = np.searchsorted(first, place, side="right") - 1
                inside = place + width <= first[doc + 1]
                docs.append(doc[inside])
                seeds.append(h[place[inside]].view(np.int64))
            pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(seeds)]), axis=1)
            if not pairs.shape[1]:
                continue
            rows, at = np.unique(pairs[0], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows)) for c in carried),
                 pa.array([words[first[d]:first[d + 1]].tobytes() for d in rows], pa.binary()),
                 pa.array([s.tolist() for s in np.split(pairs[1], at[1:])], pa.list_(pa.int64()))],
                names=[*carried, "words", "seeds"])
    return run


def _tiles(threshold: float, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, (body, items) in enumerate(zip(batch.column("words"), batch.column("items"))):
                text = np.frombuffer(body.as_py(), np.uint64)
                for item in items.as_py():
                    words = np.frombuffer(item["words"], np.uint64)
                    tiles = tile(text, words, min(MIN_MATCH, len(words)))
                    matched = sum(t[2] for t in tiles)
                    if matched >= threshold * len(words):
                        at.append(k)
                        out.append((item["item_id"], len(words), matched, len(tiles), matched / len(words)))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(at)) for c in carried), *(pa.array(x, pa.int64()) for x in columns[:4]),
                     pa.array(columns[4], pa.float64())],
                    names=[*carried, "item_id", "item_words", "matched_words", "tiles", "coverage"])
    return run


def _salted(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that may repeat very often in ``many``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return many.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(
        few.select("*", salts), [key, "salt"]).drop("salt")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 short_items: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and item that the document covers to ``threshold``
    (``doc_id``, ``carry``, ...); with ``short_items`` also items of fewer than
    ``MIN_MATCH`` words."""
    items = item_table(benchmark, short_items)
    seeds = candidate_seeds(items, threshold)
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    carried = ["__doc", *[f"__c{i}" for i in range(len(carry))]]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("__doc"),
                       *[F.col(c).alias(a) for c, a in zip(carry, carried[1:])], C.text_bytes().alias("body"))
    kinds = ", ".join(f"{c} {k}" for c, k in rows.drop("body").dtypes)
    hits = C.through_table(rows.mapInArrow(
        _hits(bit_map(seeds), widths, carried), f"{kinds}, words binary, seeds array<bigint>").withColumn(
        "row", F.monotonically_increasing_id()), "hit-texts")
    shares = hits.select("row", F.explode("seeds").alias("seed"))
    pairs = C.through_table(_salted(shares, seeds, "seed").select("row", "item").distinct(), "pairs")
    lots = pairs.groupBy("row").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    packed = _salted(pairs, items.select("item", "item_id", F.col("words").alias("item_words")), "item").join(
        lots, "row").groupBy("row", F.pmod(F.xxhash64("item"), F.col("lots")).alias("lot")).agg(
        F.collect_list(F.struct("item_id", F.col("item_words").alias("words"))).alias("items"))
    met = hits.drop("seeds").join(packed, "row").select(*carried, "words", "items")
    found = met.mapInArrow(_tiles(threshold, carried), f"{kinds}, {FOUND[len('doc_id bigint, '):]}")
    return found.select(F.col("__doc").alias("doc_id"), *[F.col(a).alias(c) for c, a in zip(carry, carried[1:])],
                        "item_id", "item_words", "matched_words", "tiles", "coverage")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark")
    return C.few_files(contaminated(docs, benchmark, short_items=True))
