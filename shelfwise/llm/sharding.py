"""Shards of nearly equal size by longest-processing-time scheduling.

Rows of one group (by default: of one text) stay together. Groups are taken from the largest to
the smallest, each into the least loaded shard, which a heap names. What the schedule does
depends on sizes only, so it runs over a table of sizes and not over the groups: a size above one
``UNITS``-th of a shard's share counts as it is (there can be at most ``UNITS`` x shards such
groups), smaller ones are taken together with sizes that share their ``CLASS_BITS`` bits after the
first. That table is bounded whatever the input and comes to the driver. A class of many groups
is dealt at once: the heap's result for groups of one size has a closed form up to the last round.
Inside a class groups are ranked by size with a global sort and dealt in rounds that run forth
and back, so that within a class the shards differ by less than the sizes in it do.

Slots number the rows of a shard from 0, by key; a shard is not brought into one task.

Defined cases: a null text counts as the empty one (size 1) and shares its group; a null key
comes first in its shard; repeated rows are rows of one group; a group larger than a shard's share
makes its shard larger than the others; an empty table gives an empty result; input columns named
like a result are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import texts, written
from shelfwise.llm.scans import in_order, join_hot, scan

SHARDS = 8
UNITS = 1024
CLASS_BITS = 8
RESULTS = ("size", "law", "shard", "slot", "grown_shard")


def deal(loads: Sequence[int], n: int, size: int) -> list[int]:
    """How many of ``n`` groups of one size each shard gets, every one going to the least loaded.

    The shards fill up to a common level, found by bisection; the rest, less than one round,
    goes through the heap. Ties go to the smaller shard.
    """

    def below(level: int) -> list[int]:
        return [max(0, -(-(level - load) // size)) for load in loads]

    counts = [0] * len(loads)
    if n > 2 * len(loads):
        low, high = min(loads), max(loads) + n * size + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= n else (low, middle)
        counts = below(low)
    heap = [(load + c * size, i) for i, (load, c) in enumerate(zip(loads, counts))]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):
        load, i = heap[0]
        counts[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    return counts


def rounds(counts: Sequence[int], loads: Sequence[int]) -> list[tuple[int, list[int]]]:
    """(first rank, shards that take part): shards that get more than others start earlier."""
    order = sorted(range(len(counts)), key=lambda i: (-counts[i], loads[i], i))
    found, start = [], 0
    for j, i in enumerate(order, 1):
        more = counts[i] - (counts[order[j]] if j < len(order) else 0)
        if more:
            found.append((start, order[:j]))
            start += j * more
    return found


def schedule(classes: Sequence[tuple[int, int, int]], shards: int) -> list[tuple]:
    """``classes``: (class, groups, bytes). Per class, which ranks go to which shards."""
    loads, plan = [0] * shards, []
    for key, n, total in sorted(classes, reverse=True):
        counts = deal(loads, n, max(1, total // n))
        plan.append((key, rounds(counts, loads)))
        loads = [load + c * total // n for load, c in zip(loads, counts)]
    return plan


def size_class(size: Column, limit: int, bits: int = CLASS_BITS) -> Column:
    """Sizes above the limit as they are; of the others, the leading bits."""
    unit = F.pow(F.lit(2), F.greatest(F.length(F.bin(size)) - F.lit(bits + 1), F.lit(0))).cast("bigint")
    return F.when(size > limit, size).otherwise(size - size % unit)


def assign(groups: DataFrame, shards: int, units: int = UNITS, bits: int = CLASS_BITS) -> DataFrame:
    """``groups`` (stored): _group, _bytes, _rows. Returns _group, _rows and shard."""
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    classed = groups.withColumn("_class", size_class(F.col("_bytes"), total // (shards * units), bits))
    table = classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b"))
    plan = schedule([tuple(r) for r in table.collect()], shards)
    schema = "_class bigint, _rounds array<struct<start:bigint,shards:array<int>>>"
    known = groups.sparkSession.createDataFrame(plan, schema)
    ordered = in_order(classed.withColumn("_one", F.lit(1).cast("bigint")),
                       "_class", F.desc("_bytes"), "_group")
    ranked = scan(ordered, "_class", {"_rank": "_one"}).join(F.broadcast(known), "_class")
    part = F.element_at(F.filter("_rounds", lambda p: p["start"] <= F.col("_rank")), -1)
    ranked = ranked.withColumn("_part", part).withColumns({
        "_at": F.col("_rank") - F.col("_part.start"), "_wide": F.size("_part.shards")})
    forth = F.floor(F.col("_at") / F.col("_wide")) % 2 == 0
    place = F.col("_at") % F.col("_wide")
    place = F.when(forth, place).otherwise(F.col("_wide") - 1 - place)
    return ranked.select("_group", "_rows", F.get("_part.shards", place.cast("int")).alias("shard"))


def shard_by_size(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS,
    group: Column | None = None, keep: Sequence[str] | None = None,
) -> DataFrame:
    """All rows with size, law (`bytes`), shard, slot and grown_shard (null under this law).

    ``group``: rows with equal values stay together; equal texts if not given. ``keep`` names the
    input columns that the result has (default: all); no other is shuffled.
    """
    body = texts(F.col(f"`{text}`")).cast("binary")
    kept = docs.columns if keep is None else list(keep)
    together = body if group is None else F.coalesce(group.cast("string"), F.lit("\0")).cast("binary")
    rows = written(docs.select(
        *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)],
        F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("_row"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.unhex(F.sha2(together, 256)).alias("_group"),
    ))
    groups = written(rows.groupBy("_group").agg(
        F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")))
    placed = join_hot(rows, written(assign(groups, shards)), "_group", "_rows").drop("_rows", "_group")
    placed = placed.withColumns({"_shard": F.col("shard").cast("bigint"), "_one": F.lit(1).cast("bigint")})
    slots = scan(in_order(placed, "_shard", "_key", "_row"), "_shard", {"slot": "_one"})
    return slots.select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept) if c.lower() not in RESULTS],
        "size", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
