"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns are reduced to a digest and a size before anything is shuffled. A conversation's
turns are numbered and its prefixes identified by running totals, which split a
conversation of very many turns over tasks (``operators/prefix.py``): a prefix is the sum,
modulo 2 ** 32 in four lanes, of hashes of (depth, digest of the turn), 128 bits from two
hashes. Two different prefixes of one depth count as one with a chance of about 2 ** -128.

Nodes are aggregates over prefixes, so a first turn or a whole conversation that very many
share is summed before it is shuffled. Leaves and saved tokens of the subtrees come from
``tree_contraction``. The digest over a node's members is taken by a stream over chunks of
at most ``1 << CHUNK_BITS`` sorted ids each.

Defined results: turns order by number (null first), then by the digest of role and text,
so repeated rows are turns of their own; null role and text are empty; rows without a
``conv_id`` take no part; an empty table gives an empty one (no root); further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockline.llm.store import keep, text_or_empty
from stockline.llm.tree_contraction import subtree_totals
from stockline.operators.prefix import running_totals

CHUNK_BITS = 12
GROUP = 5           # conversations of one group share the head of its first
MOST_HEAD = 9       # heads are shorter than this
_LANES = ("s1", "s2", "s3", "s4")
_HALF = 1 << 32


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_HEAD


def rebuilt_turns(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, digest, bytes, length`` of all rebuilt turns (depth from 1), and ``conv_id, length`` of all conversations."""
    role, text = text_or_empty("role"), text_or_empty("text")
    turns, _ = keep(table.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes")), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    numbered, _ = keep(running_totals(turns, ["conv_id"], order, {"place": F.lit(1).cast("long")}).drop("turn"), "numbered-turns")
    sizes = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.withColumns({"h": head_length(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shapes, _ = keep(convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))).select(
        "conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversation-shapes")
    own = numbered.join(shapes.drop("base"), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("head") + 1).alias("depth"), "digest", "bytes", "length")
    # At most MOST_HEAD - 1 turns meet at most GROUP conversations.
    first = numbered.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < MOST_HEAD - 1)).withColumnRenamed("conv_id", "base")
    heads = first.join(shapes, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes", "length")
    return own.unionByName(heads), shapes.select("conv_id", "length")


def _key(lanes: list[Column]) -> tuple[Column, Column]:
    a, b, c, d = (x % _HALF for x in lanes)
    return F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d)


def prefixes(table: DataFrame) -> DataFrame:
    """One row per member of each node: its prefix ``k1, k2, depth``, that of the parent ``p1, p2``, and whether it ``ends`` there."""
    rows, members = rebuilt_turns(table)
    rows, _ = keep(rows, "rebuilt-turns")
    hashes = [F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2)]
    parts = [p for h in hashes for p in (F.shiftrightunsigned(h, 32), h.bitwiseAND(_HALF - 1))]
    summed = running_totals(rows, ["conv_id"], [F.col("depth")], dict(zip(_LANES, parts)))
    p1, p2 = _key([F.col(s) for s in _LANES])
    k1, k2 = _key([F.col(s) + p for s, p in zip(_LANES, parts)])
    none = F.lit(None).cast("long")
    root = members.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
                          none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("ends"))
    return summed.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "bytes",
                         (F.col("depth") == F.col("length")).alias("ends")).unionByName(root)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per run of rows with equal keys, over their chunks; the open run goes on in the next batch."""
    now, state, out = None, None, []

    def rows():
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())], names=["k1", "k2", "depth", "sha"])

    for batch in batches:
        for *key, chunk in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key == now:
                state.update(b"," + chunk.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(chunk.encode())
        if out:
            yield rows()
            out = []
    if now is not None:
        out.append((*now, state.hexdigest()))
        yield rows()


def member_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, depth, sha`` over the ascending, comma-joined ``conv_id`` of each key's rows."""
    key = ["k1", "k2", "depth"]
    chunks = ends.groupBy(*key, F.shiftright("conv_id", CHUNK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("chunk"))
    return chunks.repartition(*key).sortWithinPartitions(*key, "block").select(*key, "chunk").mapInArrow(_digests, "k1 long, k2 long, depth long, sha string")


def trie(table: DataFrame) -> DataFrame:
    """Per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows, _ = keep(prefixes(table), "prefixes")
    key = ["k1", "k2", "depth"]
    nodes, _ = keep(rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    ).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kids = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    shaped, _ = keep(nodes.join(parents, ["p1", "p2", "depth"], "left").join(kids, key, "left").select(
        "id", "parent", "conv_id", *key[:2], "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "trie-shape")
    totals = subtree_totals(shaped.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    digests = member_digests(rows.where("ends"))
    return shaped.join(totals, "id").join(digests, key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
