"""Prefix trie of conversations by collapsing whole sequences.

Plan
----
1. Turns become thin rows: a 128-bit digest of (role, text) and a word count, made
   in the JVM. Texts are never shuffled.
2. Turns are numbered within their conversation, the conversations rebuilt, and
   every rebuilt turn gets the code of the prefix that ends there (sums modulo
   2^60, in two lanes, of hashes of place and digest), by :func:`running.running`:
   a conversation of any length is spread over many tasks.
3. Whole-sequence collapse: equal rebuilt conversations are one weighted sequence
   with its smallest member, its weight and the digest of its list of ends.
   Members are dealt by ranges of ids, packed per sequence there, and only packed
   pieces meet, in order; the list is hashed as a stream, never held.
4. Sequences that are a proper prefix of another one go (anti-join against all
   inner prefixes); what stays are the leaves.
5. Weighted prefixes are aggregated (sums and minima, map-side combined, so the
   root or a first turn that all share gathers no rows): members, leaves, and the
   saved tokens of the whole subtree. A subtree's sum over nodes of
   (members - 1) x words is the weighted sum of the words left on its sequences
   less each node's words once; a node is counted on the sequence of its smallest
   member, which represents it and all nodes below it on that sequence.

Equal turns are those of equal digest (MD5 of the role's length, role and text),
equal prefixes those of equal depth and code.

Cases: rows without conv_id take no part; null role or text is empty; turns of one
number are ordered by the digest, repeated rows are turns of their own; a
conversation that is left without turns is a member of the root; texts of any
length are only hashed and counted in their row; an empty table has no nodes, not
even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm.running import CODE_BITS, MASK, running

GROUP = 20
SHARED = 4
PIECE = 4096  # ids of one packed row
KEY = ["depth", "s1", "s2"]
PIECES = "depth bigint, s1 bigint, s2 bigint, first bigint, ids binary, n bigint"
SEQUENCES = "depth bigint, s1 bigint, s2 bigint, conv_id bigint, weight bigint, ends_sha256 string"
NO_ENDS = hashlib.sha256().hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_code, n_words): thin rows, numbered from 1 by turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    thin = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn_code"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_words"))
    path = C.work_dir(conversations.sparkSession, "turns")
    thin.write.parquet(path)
    thin = conversations.sparkSession.read.schema(thin.schema).parquet(path)
    return running(thin, "conv_id", ["turn", "turn_code"], name="turns-numbered").drop("turn")


def rebuilt(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h = crc32(c) % ``shared`` turns taken
    from conversation c - c % ``group``: rows (conv_id, pos, turn_code, n_words)
    and the ids of all conversations."""
    h = F.crc32(F.col("conv_id").cast("string")) % shared
    members = C.through_table(turns.select("conv_id").distinct(), "conversations")
    lenders = turns.where(F.col("pos") < shared).select(
        F.col("conv_id").alias("base"), F.col("pos"), "turn_code", "n_words")
    asked = members.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lent = asked.where("h > 0").join(lenders, "base").where("pos <= h")
    # a base of fewer turns leaves a gap that the own turns close
    sizes = lenders.groupBy("base").agg(F.max("pos").alias("n"))
    gaps = asked.where("h > 0").join(sizes, "base", "left").select(
        "conv_id", (F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).alias("gap")).where("gap > 0")
    own = turns.where(F.col("pos") > h).join(gaps, "conv_id", "left").withColumn(
        "pos", F.col("pos") - F.coalesce("gap", F.lit(0)))
    columns = ["conv_id", "pos", "turn_code", "n_words"]
    return lent.select(columns).unionByName(own.select(columns)), members


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and id to packed rows of comma-joined ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in KEY]
        ids = batch.column("conv_id").to_numpy()
        new = np.zeros(len(ids), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = True
        edges = [*np.flatnonzero(new).tolist(), len(ids)]
        starts = [a for lo, hi in zip(edges, edges[1:]) for a in range(lo, hi, PIECE)]
        stops = [min(a + PIECE, hi) for lo, hi in zip(edges, edges[1:]) for a in range(lo, hi, PIECE)]
        texts = list(map(str, ids.tolist()))
        yield pa.RecordBatch.from_arrays([
            *[pa.array(c[starts]) for c in columns], pa.array(ids[starts]),
            pa.array([",".join(texts[a:b]).encode() for a, b in zip(starts, stops)], pa.binary()),
            pa.array(np.subtract(stops, starts), pa.int64())], names=[*KEY, "first", "ids", "n"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by sequence and first id to one row per sequence."""
    schema = pa.schema([(c, pa.int64()) for c in (*KEY, "conv_id", "weight")] + [("ends_sha256", pa.string())])
    done: list[tuple] = []
    at = digest = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "first", "ids", "n"))):
            if row[:3] != at:
                if at is not None:
                    done.append((*at, first, weight, digest.hexdigest()))
                at, first, weight, digest = row[:3], row[3], 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row[4])
            weight += row[5]
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if at is not None:
        done.append((*at, first, weight, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def collapse(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct whole sequence: its key, smallest member, number of
    members and the SHA-256 of their ids in ascending order."""
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "s1", "s2")).alias("w")).select("conv_id", "w.*")
    zero = F.lit(0).cast("bigint")
    ends = members.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in KEY])
    packed = ends.repartitionByRange("conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pieces, PIECES)
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_sequences, SEQUENCES)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of the sequences ``turns`` (conv_id, pos,
    turn_code, n_words; pos without gaps from 1) of ``members`` (conv_id)."""
    lane = lambda k: F.xxhash64(F.lit(k), F.col("pos"), F.col("turn_code")).bitwiseAND(F.lit(MASK))
    coded = turns.select("conv_id", F.col("pos").alias("place"), "n_words", F.col("n_words").alias("upto"),
                         lane(1).alias("c1"), lane(2).alias("c2"), lane(1).alias("s1"), lane(2).alias("s2"))
    less = lambda s, c: (F.col(s) - F.col(c) + F.lit(1 << CODE_BITS)).bitwiseAND(F.lit(MASK))
    prefixes = C.through_table(
        running(coded, "conv_id", ["place"], sums=("upto",), codes=("s1", "s2"), name="prefixes").select(
            "conv_id", F.col("pos").alias("depth"), "s1", "s2", less("s1", "c1").alias("p1"), less("s2", "c2").alias("p2"),
            (F.col("upto") - F.col("n_words")).alias("before"), "upto"), "prefix-rows")
    sequences = C.through_table(collapse(prefixes, members), "sequences")
    ways = sequences.select("conv_id", "weight", F.col("depth").alias("length"))
    zero = F.lit(0).cast("bigint")
    roots = ways.select("conv_id", *[zero.alias(c) for c in (*KEY, "p1", "p2", "before", "upto")])
    paths = C.through_table(prefixes.unionByName(roots).join(ways, "conv_id"), "paths")

    # which sequence represents a node, and which nodes go on
    seen = C.through_table(paths.groupBy(KEY).agg(F.min("conv_id").alias("conv_id"),
                                                  F.max(F.col("depth") < F.col("length")).alias("inner")), "node-keys")
    leaves = sequences.join(seen.where("inner").select(KEY), KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    entry = seen.groupBy("conv_id").agg(F.min("depth").alias("depth"))
    skipped = paths.join(entry, ["conv_id", "depth"]).select("conv_id", F.col("depth").alias("from"),
                                                             F.col("before").alias("skipped"))
    totals = prefixes.join(sequences.select("conv_id", "depth"), ["conv_id", "depth"]).select(
        "conv_id", F.col("upto").alias("total"))
    facts = sequences.select("conv_id").join(leaves, "conv_id", "left").join(skipped, "conv_id", "left").join(
        totals, "conv_id", "left")
    total = F.coalesce("total", zero)
    once = F.when(F.col("from").isNull(), zero).otherwise(
        total - F.when(F.col("depth") >= F.col("from"), F.col("before")).otherwise(F.col("skipped")))
    nodes = C.through_table(paths.join(facts, "conv_id").groupBy(KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0))).cast("bigint").alias("n_leaves"),
        F.sum(F.col("weight") * (total - F.col("before")) - once).alias("saved_tokens"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2")), "nodes")

    # below its first node a representative is its own parent; only first nodes ask the parent's node
    tops = nodes.where("depth > 0").join(entry, ["conv_id", "depth"], "left_semi").select("conv_id", "depth", "p1", "p2")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"),
                         F.col("conv_id").alias("above"))
    parents = C.through_table(tops.join(above, ["depth", "p1", "p2"]).select("conv_id", "depth", "above"), "parents")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(
        F.count("*").alias("n_children"))
    out = nodes.join(children, KEY, "left").join(sequences.select(*KEY, "ends_sha256"), KEY, "left").join(
        parents, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    turns, members = rebuilt(turn_rows(conversations), group, shared)
    return trie(turns, members)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.few_files(conversation_trie(C.read_table(spark, sf_dir, "conversations")))
