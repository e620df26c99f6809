"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; its members are the conversations that start with
it. A conversation's turns are placed by a running count along one global sort, and the key of
every prefix is a running sum of 128 bits of mixed turn digests (which hold the turn's depth), so a
very long conversation is spread over many tasks. Rows of one key are counted before the shuffle.

Nodes are numbered by smallest member and depth: a path that keeps its smallest member has
consecutive numbers. Every node gets an enter arc and an exit arc. Entering a node is followed by
entering its first child (or leaving it), leaving it by entering its next sibling (or leaving its
parent); siblings come from a global sort by parent. ``scans.list_rank`` ranks that list: leaves
and savings weigh on the enter arcs, and a subtree's totals are the difference of the sums before
its exit and its enter arc.

Member lists are hashed as a stream: sorted globally, joined to pieces of ``PIECE`` ids in their
tasks, and only the pieces of a node follow each other through one SHA-256.

Defined cases: rows without a conversation id take no part; a null turn comes first; turns of one
number go by role, then by their digest; null roles and texts are empty; repeated rows are turns of
their own; an empty table has no conversation and gives no node, not even a root. Further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD, texts, written
from shelfwise.llm.scans import in_order, join_hot, list_rank, scan

PIECE = 1024
NO_IDS = hashlib.sha256(b"").hexdigest()
# Multipliers of the two mixing functions (odd 64-bit numbers).
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def turn_rows(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """conv, place in the conversation (from 0), two digest words a and b, and words of the text."""
    who, body = texts(F.col(f"`{role}`").cast("string")), texts(F.col(f"`{text}`").cast("string"))
    joined = F.concat_ws(":", F.octet_length(who.cast("binary")).cast("string"), who, body)
    rows = turns.where(F.col(f"`{conversation}`").isNotNull()).select(
        F.col(f"`{conversation}`").cast("bigint").alias("conv"),
        F.col(f"`{turn}`").alias("_turn"), F.xxhash64(who).alias("_who"), who.alias("_role"),
        F.sha2(joined.cast("binary"), 256).alias("_digest"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("bigint").alias("words"),
    ).select("conv", "_turn", "_role", _bits("_digest", 1).alias("a"), _bits("_digest", 17).alias("b"),
             "words", F.lit(1).cast("bigint").alias("one"))
    ordered = in_order(rows, "conv", F.asc_nulls_first("_turn"), "_role", "a", "b")
    return scan(ordered, "conv", {"place": "one"}).select("conv", "place", "a", "b", "words")


def _bits(digest: str, start: int) -> Column:
    """64 bits of a hex digest as a signed number."""
    high = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, start + 8, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def rebuilt(turns: DataFrame, span: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of every conversation c after it took the first h turns of c - c % span.

    h is the unsigned crc32 of c in decimals, modulo ``most``. ``turns``: conv, place, a, b, words.
    Returns conv, depth (from 1), a, b, words in a global order by conv and depth; and all conv.
    """
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    first = turns.where(F.col("place") < most - 1)  # at most that many per conversation
    heads = convs.select("conv", taken.alias("h"), (F.col("conv") - F.col("conv") % span).alias("base"))
    borrowed = first.withColumnRenamed("conv", "base").join(heads, "base").where("place < h")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    names = ["conv", "part", "place", "a", "b", "words", "one"]
    own = turns.where(F.col("place") >= taken).withColumns({"part": one, "one": one})
    both = own.select(*names).unionByName(
        borrowed.withColumns({"part": zero, "one": one}).select(*names))
    placed = scan(in_order(both, "conv", "part", "place"), "conv", {"before": "one"})
    return placed.select("conv", (F.col("before") + 1).alias("depth"), "a", "b", "words"), convs.select("conv")


def _mixed(digest: np.ndarray, depth: np.ndarray, odd: int) -> np.ndarray:
    """64 well-spread bits of a digest word and a depth."""
    x = digest.view(np.uint64) ^ (depth.view(np.uint64) * np.uint64(odd))
    for shift in (30, 27):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the keys (k1, k2) of the prefix that ends in each turn, and (p1, p2) of the one before."""

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("depth", "a", "b"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv", "depth", "words")],
                 *[pa.array(_mixed(x, depth, odd)) for x, odd in zip((a, b), MIXERS)]],
                names=["conv", "depth", "words", "m1", "m2"])

    mixed = turns.mapInArrow(mix, "conv bigint, depth bigint, words bigint, m1 bigint, m2 bigint")
    summed = scan(mixed, "conv", {"p1": "m1", "p2": "m2"})
    # try_add gives null beyond 64 bits, so the wrapped sum goes by halves.
    return summed.select("conv", "depth", "words", "p1", "p2",
                         _wrapping("p1", "m1").alias("k1"), _wrapping("p2", "m2").alias("k2"))


def _wrapping(x: str, y: str) -> Column:
    """x + y modulo 2^64, in two halves of 32 bits."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    low = F.col(x).bitwiseAND(mask) + F.col(y).bitwiseAND(mask)
    high = (F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32)
            + F.shiftrightunsigned(low, 32)).bitwiseAND(mask)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """id, parent (id, null for the root), parent_conv_id, conv_id, depth, n_convs, own, k1, k2.

    ``own``: (members - 1) times the words of the last text. Stored.
    """
    found = rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs",
                       zero.alias("words"), zero.alias("p1"), zero.alias("p2"))
    whole = found.unionByName(root).select(
        "*", ((F.col("n_convs") - 1) * F.col("words")).alias("own"),
        F.lit(1).cast("bigint").alias("one"), zero.alias("all"))
    nodes = scan(in_order(whole, "conv_id", "depth"), "all", {"id": "one"}).drop("one", "all", "words")
    key = F.struct("depth", "k1", "k2")
    parents = nodes.select(key.alias("up"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upward = F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = nodes.where("depth > 0").withColumn("up", upward)
    counted = children.groupBy("up").agg(F.count(F.lit(1)).alias("n_children"))
    joined = join_hot(children, written(parents.join(counted, "up")), "up", "n_children")
    joined = joined.drop("up", "n_children", "p1", "p2")
    top = nodes.where("depth = 0").drop("p1", "p2").withColumns(
        {"parent": F.lit(None).cast("bigint"), "parent_conv_id": F.lit(None).cast("bigint")})
    return written(joined.unionByName(top))


def tour(nodes: DataFrame) -> DataFrame:
    """The tour as a list of arcs: id (2 x node: enter, 2 x node + 1: exit), next, leaves, saved.

    Also returns, on the enter arcs, the node's number of children.
    """
    below = nodes.where("parent is not null")
    later = scan(in_order(below.select("id", "parent"), "parent", F.desc("id")), "parent",
                 before={"sibling": "id"})
    first = below.groupBy("parent").agg(F.min("id").alias("child"), F.count(F.lit(1)).alias("n_children"))
    joined = nodes.select("id", "parent", "own").join(later.select("id", "sibling"), "id", "left").join(
        first.withColumnRenamed("parent", "id"), "id", "left")
    zero = F.lit(0).cast("bigint")
    enter = F.struct(
        (F.col("id") * 2).alias("id"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("next"),
        F.when(F.col("child").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("leaves"),
        F.col("own").alias("saved"), F.coalesce("n_children", zero).alias("n_children"))
    leave = F.struct(
        (F.col("id") * 2 + 1).alias("id"),
        F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.lit(-1).cast("bigint")).alias("next"),
        zero.alias("leaves"), zero.alias("saved"), zero.alias("n_children"))
    return written(joined.select(F.inline(F.array(enter, leave))))


def member_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each node's own members; ``ends``: conv_id, depth (the node), conv."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("conv_id", "depth")])
            conv = batch.column("conv").to_pylist()
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = np.unique(np.concatenate([[0], cut, np.arange(0, len(conv), PIECE), [len(conv)]]))
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            at = bounds[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[0][at]), pa.array(key[1][at]), pa.array([conv[a] for a, _ in spans], pa.int64()),
                 pa.array([",".join(map(str, conv[a:b])) for a, b in spans], pa.string())],
                names=["conv_id", "depth", "start", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
                if (a, b) != now:
                    if now is not None:
                        done.append((*now, hashed.hexdigest()))
                    now, hashed = (a, b), hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
            if done:
                yield _table(done)
        if now is not None:
            yield _table([(*now, hashed.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))],
            names=["conv_id", "depth", "ends_sha256"])

    ordered = ends.orderBy("conv_id", "depth", "conv")
    joined = ordered.mapInArrow(pieces, "conv_id bigint, depth bigint, start bigint, ids string")
    dealt = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "start")
    return dealt.mapInArrow(digests, "conv_id bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node. ``turns``: conv, depth, a, b, words in a global order by conv and depth
    (as ``rebuilt`` gives); ``convs``: conv, one row per conversation, also those without turns."""
    rows = written(prefixes(turns))
    convs = written(convs)
    nodes = trie_nodes(rows, convs)
    arcs = tour(nodes)
    ranked = list_rank(arcs, ["leaves", "saved"])
    zero = F.lit(0).cast("bigint")
    first, last = F.col("id") % 2 == 0, F.col("id") % 2 == 1
    totals = ranked.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(*[
        (F.max(F.when(last, F.col(c))) - F.max(F.when(first, F.col(c)))).alias(c) for c in ("leaves", "saved")])
    children = arcs.where(first).select(F.floor(F.col("id") / 2).alias("id"), "n_children")

    longest = rows.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("key"))
    every = convs.join(longest, "conv", "left").select(
        "conv", *[F.coalesce(f"key.{c}", zero).alias(c) for c in ("depth", "k1", "k2")])
    key = F.struct("depth", "k1", "k2")
    counted = every.groupBy("depth", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    of = written(counted.join(nodes.select("depth", "k1", "k2", "conv_id"), ["depth", "k1", "k2"]).select(
        key.alias("key"), "conv_id", "n"))
    ends = join_hot(every.select("conv", key.alias("key")), of, "key", "n").select(
        "conv_id", F.col("key.depth").alias("depth"), "conv")
    hashes = written(member_hashes(ends))
    out = nodes.join(totals, "id").join(children, "id").join(hashes, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
