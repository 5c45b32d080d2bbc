"""Language ID by partial matching: per language a variable-order byte context
tree whose escape probabilities give exact code lengths under frozen counts.

A byte is coded in its longest context (up to ``ORDER`` bytes) that the language
has seen; a byte the context has not seen costs an escape and is looked for in
the next shorter one, where the bytes already ruled out no longer take part
(method C with exclusions); below all contexts the bytes left are equally
likely. The language with the shortest code for the whole text wins.

Plan: the trees are counted from a bounded sample (``SAMPLE_DOCS`` texts of each
learned language at most, those with the smallest hash of their id, none of the
held-out fold, and ``LEARN_BYTES`` of text over all languages, dealt evenly). The
sample is picked among ids and hashes in two steps, by language and salt, then by
language, so no task sees more of a language than ``SAMPLE_DOCS`` rows a salt. The
sparse counts, a few megabytes, go to the tasks; each worker unfolds them once into
code lengths per context, byte and language, so scoring is table lookups over whole
texts, one ``mapInArrow``, no shuffle. The table holds the most frequent contexts
(``MAX_CONTEXTS``, and ``TABLE_BYTES`` over all languages) and their ends; what
follows any other context that was seen is coded from the counts directly, once per
context and byte of a block, with the same result.

Cases: texts of any length are scored whole, in blocks of ``BLOCK_BYTES`` that overlap
by the context; an empty table gives no rows; null texts and texts without a letter are ``und`` with score 0; without
anything learned all are; equal code lengths go to the first language by name;
repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm import common as C

ORDER = 3
SAMPLE_DOCS = 600
SAMPLE_TEXT_BYTES = 1 << 18
SALTS = 64
LEARN_BYTES = 64 << 20  # of all languages together
MAX_CONTEXTS = 60_000  # in the table; the others are coded from the counts
TABLE_BYTES = 64 << 20
BROADCAST_ROWS = 100_000
BLOCK_BYTES = 1 << 20
UNKNOWN = "und"


class ContextTrees:
    """Frozen counts of (context, byte) per language. Symbol 0 stands for every
    byte value that was never seen and for what lies before a text."""

    def __init__(self, texts: dict[str, list[bytes]], max_contexts: int = MAX_CONTEXTS) -> None:
        self.langs = sorted(texts)
        seen = np.zeros(256, bool)
        for group in texts.values():
            for t in group:
                seen[np.frombuffer(t, np.uint8)] = True
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, int(seen.sum()) + 1)
        self.size = int(seen.sum()) + 1
        self.spare = 256 - int(seen.sum())  # byte values behind symbol 0
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        for lang in self.langs:
            body = b"".join(texts[lang])
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts[lang]]))).astype(np.int64)
            context, symbol = self.contexts(np.frombuffer(body, np.uint8), offsets)
            self.grams.append(np.unique(context * self.size + symbol, return_counts=True))
        keys = [k // self.size for k, _ in self.grams]
        total, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
        weight = np.bincount(counts, np.concatenate([n for _, n in self.grams]) if keys else None, len(total))
        room = TABLE_BYTES // (4 * self.size * max(len(self.langs), 1))
        order = np.lexsort((total, -weight))[:min(max_contexts, room)]
        self.every, self.kept = total, np.sort(total[order])
        parts = [self.kept.tobytes(), *(k.tobytes() + n.tobytes() for k, n in self.grams)]
        self.name = hashlib.sha256(b"".join(parts)).hexdigest()
        self.sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # filled by _level
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}  # filled by _node

    def __getstate__(self) -> dict:
        return {**self.__dict__, "sums": {}, "nodes": {}}

    def contexts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context number and symbol of every byte of texts laid end to end."""
        lengths = np.diff(offsets)
        line = np.zeros(len(data) + ORDER * len(lengths), np.int64)
        at = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, len(lengths) + 1), lengths)
        symbol = self.symbol[data]
        line[at] = symbol
        context = np.zeros(len(data), np.int64)
        for back in range(ORDER, 0, -1):
            context = context * self.size + line[at - back]
        return context, symbol

    def _counts(self, lang: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The (context, symbol) numbers of ``order`` bytes of context, and their counts."""
        if (lang, order) not in self.sums:
            keys, counts = self.grams[lang]
            codes, back = np.unique(keys % self.size ** (order + 1), return_inverse=True)
            self.sums[lang, order] = codes, np.bincount(back, counts, len(codes))
        return self.sums[lang, order]

    def _node(self, lang: int, order: int) -> tuple[np.ndarray, ...]:
        """Per context of ``order`` bytes that was seen: its number, the sum of its
        counts, its number of symbols, and the sum of the counts that these symbols
        have in the next shorter context (where they are ruled out)."""
        if (lang, order) not in self.nodes:
            codes, counts = self._counts(lang, order)
            names, first = np.unique(codes // self.size, return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else counts
            below = np.zeros(len(names))
            if order and len(first):
                shorter, sums = self._counts(lang, order - 1)
                below = np.add.reduceat(sums[np.searchsorted(shorter, codes % self.size ** order)], first)
            self.nodes[lang, order] = names, total, np.diff([*first, len(codes)]).astype(float), below
        return self.nodes[lang, order]

    def _level(self, lang: int, order: int, wanted: np.ndarray) -> np.ndarray:
        """Counts of every symbol in each wanted context of ``order`` bytes."""
        codes, sums = self._counts(lang, order)
        context, symbol = codes // self.size, codes % self.size
        names, place = np.unique(wanted, return_inverse=True)
        out = np.zeros((len(names), self.size))
        at = np.searchsorted(names, context)
        hit = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == context)
        out[at[hit], symbol[hit]] = sums[hit]
        return out[place]

    def code_lengths(self, lang: int, order: int, contexts: np.ndarray) -> np.ndarray:
        """Bits of every symbol after each context of ``order`` bytes."""
        bits = np.zeros((len(contexts), self.size))
        left = np.ones((len(contexts), self.size), bool)  # symbols not coded yet, nor ruled out
        spent = np.zeros(len(contexts))
        for k in range(order, -1, -1):
            counts = np.where(left, self._level(lang, k, contexts % self.size ** k), 0.0)
            total, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
            whole = total + kinds
            here = counts > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(here, spent[:, None] - np.log2(counts / whole[:, None]), bits)
                spent = spent + np.where(kinds > 0, -np.log2(kinds / np.maximum(whole, 1)), 0.0)
            left &= ~here
        # what is left are byte values, equally likely; symbol 0 is any of its own
        values = left[:, 1:].sum(axis=1) + self.spare
        return np.where(left, (spent + np.log2(np.maximum(values, 1)))[:, None], bits)

    def unfold(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each context of ORDER symbols, bits[row * size + symbol, language]).
        A context that was never seen shares the row of its longest end that was;
        row -1 if that end, or the context itself, is not in the table."""
        row_of, tables, rows = None, [], 0
        for order in range(ORDER + 1):
            known = np.unique(self.kept % self.size ** order)
            table = np.empty((len(known), self.size, len(self.langs)), np.float32)
            for lang in range(len(self.langs)):
                for at in range(0, len(known), 4096):
                    table[at:at + 4096, :, lang] = self.code_lengths(lang, order, known[at:at + 4096])
            if order == 0:
                row_of = np.zeros(1, np.int32)
                known = np.zeros(1, np.int64)
                if not len(table):
                    table = np.empty((1, self.size, len(self.langs)), np.float32)
                    for lang in range(len(self.langs)):
                        table[:, :, lang] = self.code_lengths(lang, 0, known)
            else:
                row_of = np.tile(row_of, self.size)
                row_of[self.every % self.size ** order] = -1
            row_of[known] = rows + np.arange(len(known))
            tables.append(table.reshape(-1, len(self.langs)))
            rows += len(known)
        return row_of, np.concatenate(tables)

    def pair_bits(self, lang: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of each symbol after its context, from the counts: what a longer
        context has seen is also seen in the shorter ones, so a context's sums less
        those of the longer context's symbols are all that the exclusions leave."""
        bits, spent = np.zeros(len(context)), np.zeros(len(context))
        left = np.ones(len(context), bool)
        gone, gone_kinds = np.zeros(len(context)), np.zeros(len(context))  # ruled out by the longer context

        def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
            return at, (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool)
        for k in range(ORDER, -1, -1):
            names, total, kinds, below = self._node(lang, k)
            codes, counts = self._counts(lang, k)
            if not len(names):
                continue
            here = context % self.size ** k
            at, seen = find(names, here)
            free = np.where(seen, total[at] - gone, 0.0)
            free_kinds = np.where(seen, kinds[at] - gone_kinds, 0.0)
            whole = free + free_kinds
            place, hit = find(codes, here * self.size + symbol)
            hit &= left
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(hit, spent - np.log2(counts[place] / whole), bits)
                spent = spent + np.where(free_kinds > 0, -np.log2(free_kinds / whole), 0.0)
            left &= ~hit
            gone, gone_kinds = np.where(seen, below[at], 0.0), np.where(seen, kinds[at], 0.0)
        values = self.size - 1 - gone_kinds + self.spare
        return np.where(left, spent + np.log2(np.maximum(values, 1)), bits)

    def direct_bits(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of each symbol after its context, by language, from the counts."""
        pairs, back = np.unique(context * self.size + symbol, return_inverse=True)
        table = np.empty((len(pairs), len(self.langs)), np.float32)
        for lang in range(len(self.langs)):
            table[:, lang] = self.pair_bits(lang, pairs // self.size, pairs % self.size)
        return table[back]

    def total_bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text (rows) under each language (columns)."""
        row_of, bits, counted = unfolded(self)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        doc = 0
        while doc < len(out):
            stop = max(int(np.searchsorted(offsets, offsets[doc] + BLOCK_BYTES, side="right")) - 1, doc + 1)
            stop = min(stop, len(out))
            part = offsets[doc:stop + 1]
            # a longer text goes in pieces that overlap by the context
            for at in range(int(part[0]), int(part[-1]), BLOCK_BYTES):
                end = min(at + BLOCK_BYTES, int(part[-1]))
                back = 0 if at == part[0] else ORDER
                cut = np.array([0, end - at + back]) if stop == doc + 1 else part - part[0]
                context, symbol = self.contexts(data[at - back:end], cut)
                context, symbol = context[back:], symbol[back:]
                row = row_of[context].astype(np.int64)
                code = bits[np.maximum(row, 0) * self.size + symbol]
                beyond = np.flatnonzero(row < 0)
                if len(beyond):
                    code[beyond] = counted.direct_bits(context[beyond], symbol[beyond])
                if stop == doc + 1:
                    out[doc] += code.sum(axis=0, dtype=np.float64)
                else:
                    some = np.flatnonzero(np.diff(cut))
                    out[doc + some] = np.add.reduceat(code, cut[some], axis=0, dtype=np.float64)
                    break
            doc = stop
        return out


_UNFOLDED: dict[str, tuple[np.ndarray, np.ndarray, ContextTrees]] = {}


def unfolded(trees: ContextTrees) -> tuple[np.ndarray, np.ndarray, ContextTrees]:
    """The worker's code lengths of these trees, and the trees with their sums."""
    if trees.name not in _UNFOLDED:
        _UNFOLDED.clear()
        _UNFOLDED[trees.name] = (*trees.unfold(), trees)
    return _UNFOLDED[trees.name]


# --- jobs ----------------------------------------------------------------------

def learn(docs: DataFrame, rows: int = SAMPLE_DOCS) -> ContextTrees:
    """Trees from at most ``rows`` texts of each language, of at most
    ``SAMPLE_TEXT_BYTES`` bytes each; the held-out fold never is among them."""
    size = F.octet_length("text")
    known = docs.where(F.col("lang").isNotNull() & (size > 0) & (size <= SAMPLE_TEXT_BYTES) & ~C.held_out()).select(
        "lang", "doc_id", "text")
    keys = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), size.alias("size"))
    order = [F.col(c) for c in ("h", "doc_id", "t")]
    by_salt = Window.partitionBy("lang", F.pmod("t", F.lit(SALTS))).orderBy(*order)
    some = keys.withColumn("n", F.row_number().over(by_salt)).where(F.col("n") <= rows)
    by_lang = Window.partitionBy("lang").orderBy(*order)
    first = C.through_table(some.withColumn("n", F.row_number().over(by_lang)).where(F.col("n") <= rows), "sample")
    budget = LEARN_BYTES // max(first.select("lang").distinct().count(), 1)
    upto = F.sum("size").over(by_lang.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a language's first text is learned however long the list of languages is
    picked = first.withColumn("upto", upto).where((F.col("upto") <= budget) | (F.col("n") == 1)).select(
        F.col("lang").alias("l"), F.col("doc_id").alias("d"), F.col("t")).distinct()
    if picked.count() <= BROADCAST_ROWS:  # some bytes a row; with more languages Spark decides by itself
        picked = F.broadcast(picked)
    found = known.join(picked, F.col("lang").eqNullSafe(F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d"))
                       & (F.xxhash64("text") == F.col("t"))).dropDuplicates(["lang", "doc_id", "t"])
    texts: dict[str, list[tuple]] = {}
    for row in found.select("lang", "doc_id", "t", F.col("text").cast("binary").alias("body")).toLocalIterator():
        texts.setdefault(row.lang, []).append((row.doc_id is None, row.doc_id or 0, row.t, bytes(row.body)))
    return ContextTrees({k: [x[3] for x in sorted(v)] for k, v in texts.items()})


def _predict(trees: ContextTrees):
    langs = trees.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.by_bytes(batches, "body", 4 * BLOCK_BYTES):
            data, offsets = C.binary_column(batch.column("body"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            names, score = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
            if langs:
                bits = trees.total_bits(data, offsets)
                best = bits.argmin(axis=1)
                gap = bits - bits.min(axis=1, keepdims=True)
                names[letters] = np.array(langs, object)[best[letters]]
                score[letters] = (1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1))[letters]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), C.held_out().alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
                       C.text_bytes().alias("body"))
    return rows.mapInArrow(_predict(trees), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op5_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    return C.few_files(predict(docs, learn(docs)))
