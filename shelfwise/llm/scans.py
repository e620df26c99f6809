"""Running sums along a global sort, list ranking, and joins with hot keys.

All of it spreads a single long group (one conversation, one shard, one list) over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import stored, written

#: Keys that may be broadcast by ``join_hot``.
HOT_KEYS = 1024
#: List items of one task at most, and of the one task that ends a ranking.
LIST_ROWS = 1_000_000
LAST_ROWS = 65_536


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows sorted globally and stored; parts keep their order and content from then on."""
    return stored(df.orderBy(*order))


def _part() -> int:
    return TaskContext.get().partitionId()


def _longs(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """The columns as rows of one matrix of 64-bit numbers that wrap around."""
    if not names:
        return np.zeros((0, batch.num_rows), np.int64)
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])


def scan(
    ordered: DataFrame, group: str, sums: dict[str, str] | None = None,
    before: dict[str, str] | None = None,
) -> DataFrame:
    """Add running sums of the rows before each one in its group, and values of the row before.

    ``ordered`` comes from ``in_order`` (or was made from it row by row), with equal groups side
    by side. ``sums`` and ``before`` map new columns to BIGINT columns without nulls; so is
    ``group``. Sums wrap around; without a row before, ``before`` is null. Every part is read
    twice: first for what it passes on (one row per part, collected), then with what it is given.
    """
    sums, before = sums or {}, before or {}
    added, carried = list(sums.values()), list(before.values())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = tail = None
        single = True
        for batch in batches:
            if not batch.num_rows:
                continue
            g = _longs(batch, [group])[0]
            cut = np.flatnonzero(g[1:] != g[:-1]) + 1
            start = int(cut[-1]) if len(cut) else 0
            values = _longs(batch, added)[:, start:].sum(axis=1)
            if first is None:
                first = int(g[0])
            elif not len(cut) and g[0] == last:
                values = values + tail
            if len(cut) or (last is not None and g[0] != last):
                single = False
            last, tail = int(g[-1]), values
            held = _longs(batch, carried)[:, -1]
        if first is not None:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([_part()], pa.int32()), "first": pa.array([first], pa.int64()),
                "last": pa.array([last], pa.int64()), "single": pa.array([single]),
                "tail": pa.array([tail.tolist()], pa.list_(pa.int64())),
                "held": pa.array([held.tolist()], pa.list_(pa.int64()))})

    shape = "part int, first bigint, last bigint, single boolean, tail array<bigint>, held array<bigint>"
    given: dict[int, tuple[int, list[int], list[int]]] = {}
    open_group, open_sums, open_held = None, [], []
    for r in sorted(ordered.mapInArrow(ends, shape).collect(), key=lambda r: r["part"]):
        same = r["first"] == open_group
        if same:
            given[r["part"]] = (open_group, open_sums, open_held)
        total = list(r["tail"])
        if same and r["single"]:
            total = [_wrapped(a + b) for a, b in zip(total, open_sums)]
        open_group, open_sums, open_held = r["last"], total, list(r["held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, totals, values = given.get(_part(), (None, [], []))
        totals, values = np.array(totals, np.int64), np.array(values, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = _longs(batch, [group])[0]
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            lengths = np.diff(np.append(starts, len(g)))
            v = _longs(batch, added)
            upto = v.cumsum(axis=1)
            out = upto - v
            out = out - np.repeat(out[:, starts], lengths, axis=1)
            c = _longs(batch, carried)
            old = np.concatenate([c[:, :1], c[:, :-1]], axis=1)
            known = np.ones(len(g), bool)
            known[starts] = False
            if last is not None and g[0] == last:
                out[:, : lengths[0]] += totals[:, None]
                old[:, 0], known[0] = values, True
            totals = out[:, -1] + v[:, -1]
            last, values = int(g[-1]), c[:, -1]
            columns = [*batch.columns, *[pa.array(x) for x in out],
                       *[pa.array(x, mask=~known) for x in old]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *sums, *before])

    new = [T.StructField(name, T.LongType()) for name in [*sums, *before]]
    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, *new]))


def _wrapped(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, hot: int = HOT_KEYS) -> DataFrame:
    """Inner join with a table of one row per key, ``count`` being the rows of its key.

    Keys with more than one ``hot``-th of all rows, hence fewer than ``hot`` keys, are broadcast;
    what remains to be shuffled has no larger key.
    """
    limit = (table.agg(F.sum(count)).first()[0] or 0) // hot
    heavy = table.where(F.col(count) > limit)
    marked = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    done = marked.where("_heavy").drop("_heavy")
    rest = marked.where("_heavy is null").select(*rows.columns)
    light = table.where(F.col(count) <= limit)
    return done.unionByName(rest.join(light, key))


def _segments(weights: Sequence[str]):
    """Follow the list inside a part: each item's first item of the segment and sums before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [_longs(b, ["id", "next", *weights]) for b in batches if b.num_rows]
        if not have:
            return
        rows = np.concatenate(have, axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        ids, after, w = rows[0], rows[1], rows[2:]
        n = len(ids)
        at = np.minimum(np.searchsorted(ids, after), n - 1)
        inside = ids[at] == after
        previous = np.full(n, n)  # item n: none, weighs nothing
        previous[at[inside]] = np.flatnonzero(inside)
        head = np.where(previous == n, np.arange(n), previous)
        sums = np.concatenate([w, np.zeros((len(w), 1), np.int64)], axis=1)[:, previous]
        jump = np.append(previous, n)
        while (jump < n).any():  # doubles the distance: as often as the longest segment has bits
            more = np.concatenate([sums, np.zeros((len(w), 1), np.int64)], axis=1)
            sums = sums + more[:, jump[:n]]
            head = np.append(head, n)[np.where(jump[:n] < n, jump[:n], np.arange(n))]
            jump = np.append(jump[jump[:n]], n)
        arrays = [ids, ids[head], ~inside, after, *sums, *(sums + w)]
        names = ["id", "head", "tail", "next", *[f"b_{c}" for c in weights], *[f"t_{c}" for c in weights]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    return run


def list_rank(
    items: DataFrame, weights: Sequence[str], rows_per_task: int = LIST_ROWS, last_rows: int = LAST_ROWS
) -> DataFrame:
    """(id, weights): for every item of a linked list, the sums of the items before it.

    ``items``: id, next (-1 after the last one) and BIGINT weights, one list. Ranges of ids are
    followed inside their tasks, and every segment found becomes one item of a shorter list,
    which is ranked in the same way. Ids along the list make segments long. Where a round does
    not shorten the list by a quarter, what is left is ranked by pointer doubling.
    """
    n = items.count()
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 if n <= last_rows else max(2, partitions, -(-n // rows_per_task))
    sums = [f"b_{c} bigint" for c in weights] + [f"t_{c} bigint" for c in weights]
    dealt = items.coalesce(1) if parts == 1 else items.repartitionByRange(parts, "id")
    placed = written(dealt.select("id", "next", *weights).mapInArrow(
        _segments(weights), ", ".join(["id bigint, head bigint, tail boolean, next bigint", *sums])))
    if parts == 1:
        return placed.select("id", *[F.col(f"b_{c}").alias(c) for c in weights])
    shorter = placed.where("tail").select(
        F.col("head").alias("id"), "next", *[F.col(f"t_{c}").alias(c) for c in weights])
    if shorter.count() > 0.75 * n:
        ranked = pointer_doubling(shorter, weights)
    else:
        ranked = list_rank(shorter, weights, rows_per_task, last_rows)
    ranked = ranked.withColumnRenamed("id", "head")
    return placed.join(ranked, "head").select(
        "id", *[(F.col(f"b_{c}") + F.col(c)).alias(c) for c in weights])


def pointer_doubling(items: DataFrame, weights: Sequence[str]) -> DataFrame:
    """As ``list_rank``, by joins alone: every item's sum up to a point twice as far each round."""
    now = items.withColumn("items", F.lit(1).cast("bigint"))
    every = [*weights, "items"]
    zero = F.lit(0).cast("bigint")
    while now.where("next >= 0").limit(1).count():
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("n_"),
                           *[F.col(c).alias(f"a_{c}") for c in every])
        far = now.join(ahead, "next", "left")
        now = stored(far.select(
            "id", F.coalesce("n_", F.lit(-1).cast("bigint")).alias("next"),
            *[(F.col(c) + F.coalesce(f"a_{c}", zero)).alias(c) for c in every]))
    whole = now.agg(*[F.max_by(c, "items").alias(c) for c in weights]).first()
    return now.select("id", *[(F.lit(whole[c]).cast("bigint") - F.col(c)).alias(c) for c in weights])
