"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded, learned filters run over chunks of ``WIDTH`` bytes
that start every ``STEP`` bytes (so they overlap and cover the whole text, its
end padded), each filter's largest response over all chunks is kept, and a small
dense layer combines these into one probability.

Plan: the network is fitted on the driver from a bounded sample (``SAMPLE_DOCS``
labelled texts at most, those with the smallest hash of their id, none of the
held-out fold). Its weights, a few hundred kilobytes, go to the tasks with the
function; scoring is one ``mapInArrow`` over whole texts in slabs of bounded size,
without any shuffle.

Cases: null and empty texts are scored as one chunk of padding; several labels
of a document are averaged; documents without label are scored like any other;
without labelled rows of both kinds every score is the share of label 1 (0.5
without any); repeated rows get equal scores but for rounding (float32
sums); equal responses of a filter count once,
as its largest; texts of any length are scored whole, in slabs of bounded size; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C

WIDTH, STEP, DIM, FILTERS, HIDDEN = 24, 8, 8, 64, 16
PAD = 256
SAMPLE_DOCS = 6000
SAMPLE_BYTES = 1 << 26
EPOCHS = 10
LEAST_STEPS = 400  # a small sample is passed through more often
BATCH = 32
RATE = 3e-3
SLAB_BYTES = 1 << 18
BATCH_BYTES = 1 << 22


class ByteNet:
    """Embedding, filters over chunks, max over chunks, one hidden layer."""

    def __init__(self, seed: int = 7, base: float = 0.5) -> None:
        rng = np.random.default_rng(seed)
        self.base = base  # the score of everything while nothing is fitted
        self.fitted = False
        self.w = {
            "embed": rng.normal(0, 0.5, (257, DIM)), "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)),
            "bias": np.zeros(FILTERS), "inner": rng.normal(0, FILTERS ** -0.5, (FILTERS, HIDDEN)),
            "inner_bias": np.zeros(HIDDEN), "outer": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "outer_bias": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @staticmethod
    def chunks_of(n_bytes: int) -> int:
        """Chunks that cover n bytes."""
        return max(1, -(-max(n_bytes - WIDTH, 0) // STEP) + 1)

    def responses(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Filter responses of chunks 0 .. n-1 of padded byte ids."""
        rows = self.w["embed"][ids].reshape(-1, STEP * DIM)
        parts = self.w["filters"].reshape(WIDTH // STEP, STEP * DIM, FILTERS)
        out = rows[:n] @ parts[0]
        for j in range(1, WIDTH // STEP):
            out += rows[j:j + n] @ parts[j]
        return out

    @staticmethod
    def padded(data: np.ndarray) -> np.ndarray:
        ids = np.full((ByteNet.chunks_of(len(data)) - 1) * STEP + WIDTH, PAD, np.int16)
        ids[:len(data)] = data
        return ids

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = np.tanh(pooled + self.w["bias"])
        inner = np.maximum(seen @ self.w["inner"] + self.w["inner_bias"], 0)
        return seen, inner, inner @ self.w["outer"] + self.w["outer_bias"]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of texts laid end to end; bytes are taken in slabs of
        whole chunks, so memory does not follow the length of a text."""
        n_docs = len(offsets) - 1
        if not self.fitted:
            return np.full(n_docs, self.base)
        pooled = np.full((n_docs, FILTERS), -np.inf, np.float32)
        room = SLAB_BYTES // STEP
        doc, chunk = 0, 0
        while doc < n_docs:
            parts, starts, owners, filled = [], [], [], 0
            while doc < n_docs and filled < room:
                body = data[offsets[doc]:offsets[doc + 1]]
                total = self.chunks_of(len(body))
                take = min(total - chunk, room - filled)
                rows = take + WIDTH // STEP - 1
                ids = np.full(rows * STEP, PAD, np.int16)
                piece = body[chunk * STEP:chunk * STEP + rows * STEP]
                ids[:len(piece)] = piece
                parts.append(ids)
                starts.append(filled)
                owners.append(doc)
                filled += rows
                chunk += take
                if chunk == total:
                    doc, chunk = doc + 1, 0
            ids = np.concatenate(parts)
            rows = len(ids) // STEP
            out = np.empty((rows, FILTERS), np.float32)
            whole = rows - (WIDTH // STEP - 1)
            out[:whole] = self.responses(ids, whole)
            # the last rows of each piece would reach into the next piece
            ends = np.array([*starts[1:], rows])
            for back in range(1, WIDTH // STEP):
                out[ends - back] = -np.inf
            best = np.maximum.reduceat(out, starts, axis=0)
            np.maximum.at(pooled, owners, best)
        logit = self._head(pooled)[2].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> ByteNet:
        """Adam on the log loss; only the chunk that wins a filter learns."""
        labels = np.asarray(labels, np.float32)
        self.base = float(labels.mean()) if len(labels) else 0.5
        if len(np.unique(labels)) < 2:
            return self
        self.fitted = True
        rng = np.random.default_rng(seed)
        inputs = [self.padded(np.frombuffer(t, np.uint8)) for t in texts]
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        var = {k: np.zeros_like(v) for k, v in self.w.items()}
        steps = -(-len(texts) // BATCH)
        epochs = max(epochs, -(-LEAST_STEPS // steps))
        step, total = 0, epochs * steps
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                grad = self._gradient([inputs[i] for i in rows], labels[rows])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in grad.items():
                    mean[k] += 0.1 * (g - mean[k])
                    var[k] += 0.001 * (g * g - var[k])
                    self.w[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _gradient(self, inputs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        pooled = np.empty((len(inputs), FILTERS), np.float32)
        winners = np.empty((len(inputs), FILTERS), np.int64)
        for i, ids in enumerate(inputs):
            n = (len(ids) - WIDTH) // STEP + 1
            best = np.full(FILTERS, -np.inf, np.float32)
            for s in range(0, n, SLAB_BYTES // STEP):
                m = min(n - s, SLAB_BYTES // STEP)
                out = self.responses(ids[s * STEP:(s + m - 1) * STEP + WIDTH], m)
                top = out.argmax(axis=0)
                value = out[top, np.arange(FILTERS)]
                better = value > best
                best = np.where(better, value, best)
                winners[i] = np.where(better, top + s, winners[i])
            pooled[i] = best
        seen, inner, logit = self._head(pooled)
        d_logit = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels) / len(inputs)
        d_inner = np.outer(d_logit, self.w["outer"]) * (inner > 0)
        d_pooled = (d_inner @ self.w["inner"].T) * (1 - seen * seen)
        places = winners[:, :, None] * STEP + np.arange(WIDTH)
        won = np.stack([ids[p] for ids, p in zip(inputs, places)])  # documents x filters x WIDTH
        chunks = self.w["embed"][won].reshape(len(inputs), FILTERS, WIDTH * DIM)
        d_chunks = d_pooled[:, :, None] * self.w["filters"].T[None]
        d_embed = np.zeros_like(self.w["embed"])
        np.add.at(d_embed, won.ravel(), d_chunks.reshape(-1, DIM))
        return {"embed": d_embed, "filters": np.einsum("if,ifw->wf", d_pooled, chunks), "bias": d_pooled.sum(axis=0),
                "inner": seen.T @ d_inner, "inner_bias": d_inner.sum(axis=0), "outer": inner.T @ d_logit,
                "outer_bias": np.array([d_logit.sum()], np.float32)}


# --- jobs ----------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` texts (the smallest hashes of the id, at most
    ``SAMPLE_BYTES`` in all) with their label; the held-out fold never is among them."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES // 64).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), C.text_bytes().alias("body"))
    found = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "body").limit(rows)
    bodies, marks, size = [], [], 0
    for row in found.toLocalIterator():
        size += len(row.body)
        if size > SAMPLE_BYTES:
            break
        bodies.append(bytes(row.body))
        marks.append(row.label)
    return bodies, np.array(marks, np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> ByteNet:
    return ByteNet().fit(*labelled_sample(docs, labels, rows))


def _score(net: ByteNet, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.by_bytes(batches, "body", BATCH_BYTES):
            if batch.num_rows:
                scores = net.scores(*C.binary_column(batch.column("body")))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(scores)],
                                                 [*carried, "score"])
    return run


def score_quality(docs: DataFrame, net: ByteNet, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``score`` of every row."""
    names = [f"__c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], C.text_bytes().alias("body"))
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(_score(net, names), f"{fields}, score double").select(
        *[F.col(n).alias(c) for c, n in zip(carry, names)], "score")


def op1_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    net = fit_quality(docs, C.read_table(spark, sf_dir, "labels"))
    return C.few_files(score_quality(docs, net).select(
        "doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
