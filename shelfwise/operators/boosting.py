"""Gradient-boosted trees for all forecast steps at once, by shared histograms.

Features are binned once at their quantiles. Every step has its own trees, but all steps grow their
trees of one round together: per tree level, one pass over the rows adds up residuals and counts
per (step, open node, feature, bin). Tasks pass on these sums, whose size depends on the model and
never on the rows, and a tree-shaped reduction adds them up. Only the smaller child of a split is
counted; its sibling is the difference to the parent. The driver picks the splits from the sums.

A tree whose rows fit into one task is finished there (``IN_TASK_ROWS``, as in-memory subtrees of
distributed tree learners are): then each step is one task that grows all of its trees, and a fit
is one job. Sums being exact, both ways give the same trees.

Otherwise rows stay where they are: a block holds the binned features, a hash and the residuals of its rows,
and is made anew (and kept) after each round; every ``CUT_AFTER`` rounds it is checkpointed, so a
lost executor costs a few rounds at most. These blocks are an RDD: boosting needs a thousand short
passes over task-local arrays, and an RDD job starts several times faster than a planned query.

Residuals are added up on a grid of whole numbers fine enough for 50 bits, so sums are exact, and
trees do not depend on how rows lie in partitions. Rows of a round are drawn by the row's hash,
columns by a seeded generator, so a fit can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import ensure_checkpoint_dir

CUT_AFTER = 25
BLOCK_ROWS = 65_536
#: Rows of a fit whose steps are grown inside one task each.
IN_TASK_ROWS = 50_000
#: Rows that a task of a pass takes at least, and partial sums that the driver adds up itself.
TASK_ROWS = 4_000
DIRECT_SUMS = 16
SUM_BITS = 50
#: A split has to lower the squared error by this share of the node's own.
LEAST_GAIN = 1e-12
# Multipliers of the mixing function that draws rows (odd 64-bit numbers).
MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

NODE_SCHEMA = "step int, tree int, node int, feature int, threshold double, value double"


@dataclass(frozen=True)
class TreeSize:
    """Size of the ensemble; ``rows`` and ``columns`` are the shares drawn per tree."""

    trees: int = 300
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.9
    columns: float = 0.9
    bins: int = 32
    l2: float = 1.0
    least_rows: int = 1
    seed: int = 42


@dataclass(frozen=True)
class Block:
    """Binned features (rows x features), row hashes, and residuals (steps x rows)."""

    bins: np.ndarray
    hashes: np.ndarray
    residuals: np.ndarray


@dataclass(frozen=True)
class Trees:
    """One tree per step, nodes in heap order: children of i are 2i + 1 and 2i + 2.

    ``feature`` is -1 in leaves; rows with bin <= ``cut`` go left.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(steps: int, depth: int) -> Trees:
        shape = (steps, 2 ** (depth + 1) - 1)
        return Trees(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape))

    def nodes(self, bins: np.ndarray, step: int, levels: int) -> np.ndarray:
        """The node of every row after that many levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        feature, cut = self.feature[step], self.cut[step]
        for _ in range(levels):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, f] > cut[at]))
        return at


@dataclass(frozen=True)
class Ensemble:
    """Trees of all rounds (steps x trees x nodes), with thresholds in the features' own units."""

    base: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @property
    def steps(self) -> int:
        return len(self.base)

    def predict(self, x: np.ndarray, rows: int = 256) -> np.ndarray:
        """Rows x steps; ``rows`` are walked down all trees at a time."""
        steps, trees, nodes = self.feature.shape
        feature, threshold = self.feature.reshape(-1, nodes), self.threshold.reshape(-1, nodes)
        value, tree = self.value.reshape(-1, nodes), np.arange(steps * trees)[None, :]
        out = np.empty((len(x), steps))
        for a in range(0, len(x), rows):
            part = x[a: a + rows]
            at = np.zeros((len(part), steps * trees), np.int64)
            place = np.arange(len(part))[:, None]
            for _ in range(int(np.log2(nodes + 1)) - 1):
                f = feature[tree, at]
                right = part[place, f] > threshold[tree, at]
                at = np.where(f < 0, at, 2 * at + 1 + right)
            out[a: a + rows] = self.base + value[tree, at].reshape(len(part), steps, trees).sum(axis=2)
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per node that a tree uses; the base of a step is the value of node -1."""
        used = np.zeros(self.feature.shape, bool)
        used[:, :, 0] = True
        for i in range((used.shape[2] - 1) // 2):
            inner = used[:, :, i] & (self.feature[:, :, i] >= 0)
            used[:, :, 2 * i + 1] = used[:, :, 2 * i + 2] = inner
        step, tree, node = np.nonzero(used)
        table = pd.DataFrame({
            "step": step, "tree": tree, "node": node, "feature": self.feature[used],
            "threshold": self.threshold[used], "value": self.value[used]})
        first = pd.DataFrame({"step": range(self.steps), "tree": -1, "node": -1, "feature": -1,
                              "threshold": 0.0, "value": self.base})
        return spark.createDataFrame(pd.concat([first, table]), NODE_SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> Ensemble:
        """The table is as large as the model."""
        rows = df.toPandas()
        base = rows[rows.tree < 0].sort_values("step").value.to_numpy()
        rows = rows[rows.tree >= 0]
        nodes = 2 ** int(np.ceil(np.log2(rows.node.max() + 2))) - 1 if len(rows) else 1
        shape = (len(base), int(rows.tree.max() + 1) if len(rows) else 0, nodes)
        made = Ensemble(base, np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape))
        at = (rows.step.to_numpy(), rows.tree.to_numpy(), rows.node.to_numpy())
        made.feature[at], made.threshold[at], made.value[at] = rows.feature, rows.threshold, rows.value
        return made


def quantile_edges(df: DataFrame, features: str, width: int, bins: int) -> list[np.ndarray]:
    """Per feature, up to ``bins - 1`` distinct values that split its rows evenly (one aggregate).

    The largest value is no edge: nothing lies above it.
    """
    shares = [i / bins for i in range(1, bins)]
    parts = [F.struct(F.percentile_approx(F.col(features)[i], shares, 10_000).alias("q"),
                      F.max(F.col(features)[i]).alias("top")).alias(f"f{i}") for i in range(width)]
    row = df.agg(*parts).first()
    return [np.array(sorted({q for q in f["q"] or [] if q < f["top"]})) for f in row]


def _packed(df: DataFrame, features: str, labels: str, edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """The rows as blocks: bytes of the binned features, the row hashes and the residuals."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            made = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
            parts = [made.astype(_bin_type(edges)), batch.column(2).to_numpy(), (y - base).T]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]
                + [pa.array([n], pa.int32())], names=["bins", "hashes", "residuals", "n"])

    hashed = F.xxhash64(features, labels)
    return df.select(features, labels, hashed.alias("_h")).mapInArrow(
        pack, "bins binary, hashes binary, residuals binary, n int")


def _bin_type(edges: list[np.ndarray]) -> type:
    return np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16


def _block(bins: bytes, hashes: bytes, residuals: bytes, n: int, width: int) -> Block:
    kind = np.uint8 if len(bins) == n * width else np.uint16
    return Block(np.frombuffer(bins, kind).reshape(n, width), np.frombuffer(hashes, np.int64).view(np.uint64),
                 np.frombuffer(residuals).reshape(-1, n))


def _lowered(block: Block, trees: Trees, depth: int) -> Block:
    """The block with the residuals that the trees leave."""
    left = np.stack([r - trees.value[s][trees.nodes(block.bins, s, depth)] for s, r in enumerate(block.residuals)])
    return Block(block.bins, block.hashes, left)


def drawn(hashes: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a tree takes: decided by the row's hash and the tree alone."""
    if share >= 1:
        return np.ones(len(hashes), bool)
    x = hashes ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for shift, odd in zip((30, 27), MIXERS):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x >> np.uint64(11)) < np.uint64(int(share * 2**53))


def _sums(blocks: Iterator[Block], trees: Trees, levels: int, slots: np.ndarray, seeds: list[int],
          share: float, unit: float, width: int, bins: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Residual sums and row counts per (slot, feature, bin) over the blocks of a task.

    ``slots``: steps x nodes, the slot in which a node is counted, or -1.
    """
    many = int(slots.max()) + 1
    sums, counts = np.zeros(many * width * bins), np.zeros(many * width * bins, np.int64)
    offsets = np.arange(width, dtype=np.int64) * bins
    for block in blocks:
        placed = block.bins + offsets
        for step, seed in enumerate(seeds):
            slot = slots[step][trees.nodes(block.bins, step, levels)]
            rows = np.flatnonzero((slot >= 0) & drawn(block.hashes, seed, share))
            if not len(rows):
                continue
            first = int(slot[rows].min()) * width * bins
            last = (int(slot[rows].max()) + 1) * width * bins
            at = (placed[rows] + (slot[rows] * (width * bins) - first)[:, None]).ravel()
            g = np.rint(block.residuals[step][rows] * unit)
            sums[first:last] += np.bincount(at, np.repeat(g, width), last - first)
            counts[first:last] += np.bincount(at, minlength=last - first)
    shape = (many, width, bins)
    return [(sums.reshape(shape), counts.reshape(shape))]


def best_splits(
    sums: np.ndarray, counts: np.ndarray, allowed: np.ndarray, usable: np.ndarray, size: TreeSize,
    unit: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: feature (-1: no split), cut, and the gain in squared error.

    ``allowed``: nodes x features drawn for the tree; ``usable``: features x bins with an edge.
    Of equal gains the first feature and the lowest cut win.
    """
    n, width, bins = sums.shape
    left, left_n = sums.cumsum(axis=2) / unit, counts.cumsum(axis=2)
    total, total_n = left[:, :, -1:], left_n[:, :, -1:]
    right, right_n = total - left, total_n - left_n
    own = total**2 / (total_n + size.l2)
    gain = left**2 / (left_n + size.l2) + right**2 / (right_n + size.l2) - own
    fits = (left_n >= size.least_rows) & (right_n >= size.least_rows) & usable & allowed[:, :, None]
    gain = np.where(fits & (gain > LEAST_GAIN * own), gain, 0.0).reshape(n, -1)
    at = gain.argmax(axis=1)
    most = gain[np.arange(n), at]
    return np.where(most > 0, at // bins, -1), at % bins, most


def _add(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def drawn_columns(size: TreeSize, tree: int, steps: int, width: int) -> np.ndarray:
    """Which features the trees of a round may use: steps x features."""
    draw = np.random.default_rng([size.seed, tree])
    columns = np.zeros((steps, width), bool)
    for s in range(steps):
        columns[s, draw.choice(width, max(1, round(size.columns * width)), replace=False)] = True
    return columns


def row_seeds(size: TreeSize, tree: int, steps: int) -> list[int]:
    return [size.seed + 7919 * (tree * steps + s + 1) for s in range(steps)]


def _grow(
    count: Callable[[Trees, int, np.ndarray], tuple[np.ndarray, np.ndarray]], columns: np.ndarray,
    usable: np.ndarray, size: TreeSize, unit: float,
) -> Trees:
    """One tree per row of ``columns``, level by level; ``count`` is one pass over the rows: sums and
    counts of the nodes that have a slot, after so many levels of the trees so far."""
    steps, (width, bins) = len(columns), usable.shape
    made = Trees.empty(steps, size.depth)
    step, node = np.arange(steps), np.zeros(steps, np.int64)  # open nodes
    counted, parent = np.arange(steps), None
    for level in range(size.depth):
        slots = np.full(made.feature.shape, -1, np.int64)
        slots[step[counted], node[counted]] = np.arange(len(counted))
        sums, counts = count(made, level, slots)
        if level:
            other = np.empty((2 * len(counted), width, bins)), np.empty((2 * len(counted), width, bins), np.int64)
            for whole, part, up in zip(other, (sums, counts), parent):
                whole[counted] = part
                whole[counted ^ 1] = up - part  # children lie side by side: left 2i, right 2i + 1
            sums, counts = other
        else:
            total, total_n = sums[:, 0].sum(axis=1) / unit, counts[:, 0].sum(axis=1)
            made.value[step, node] = size.rate * total / (total_n + size.l2)
        feature, cut, _ = best_splits(sums, counts, columns[step], usable, size, unit)
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        f, c, s, i = feature[split], cut[split], step[split], node[split]
        made.feature[s, i], made.cut[s, i] = f, c
        left = sums[split, f].cumsum(axis=1)[np.arange(len(split)), c] / unit
        left_n = counts[split, f].cumsum(axis=1)[np.arange(len(split)), c]
        whole, whole_n = sums[split, f].sum(axis=1) / unit, counts[split, f].sum(axis=1)
        made.value[s, 2 * i + 1] = size.rate * left / (left_n + size.l2)
        made.value[s, 2 * i + 2] = size.rate * (whole - left) / (whole_n - left_n + size.l2)
        parent = sums[split], counts[split]
        step = np.repeat(s, 2)
        node = np.stack([2 * i + 1, 2 * i + 2], axis=1).ravel()
        counted = 2 * np.arange(len(split)) + (2 * left_n > whole_n)  # the smaller child
    return made


def _in_passes(packed: DataFrame, steps: int, usable: np.ndarray, size: TreeSize, unit: float) -> list[Trees]:
    """All steps' trees round by round; each level of a round is one pass over the blocks."""
    width, bins = usable.shape
    blocks = packed.rdd.map(lambda r: _block(r["bins"], r["hashes"], r["residuals"], r["n"], width))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    rounds: list[Trees] = []
    older: RDD | None = None
    for t in range(size.trees):
        seeds = row_seeds(size, t, steps)

        def count(trees: Trees, level: int, slots: np.ndarray, blocks=blocks, seeds=seeds):
            def of_task(part):
                return _sums(part, trees, level, slots, seeds, size.rows, unit, width, bins)

            sums = blocks.mapPartitions(of_task)
            if sums.getNumPartitions() > DIRECT_SUMS:
                return sums.treeReduce(_add)
            return reduce(_add, sums.collect())

        made = _grow(count, drawn_columns(size, t, steps, width), usable, size, unit)
        rounds.append(made)
        if older is not None:
            older.unpersist()
        older = blocks
        blocks = blocks.map(lambda b, made=made: _lowered(b, made, size.depth)).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % CUT_AFTER == 0 and t + 1 < size.trees:
            blocks.checkpoint()
    blocks.unpersist()
    if older is not None:
        older.unpersist()
    return rounds


def _in_tasks(packed: DataFrame, steps: int, usable: np.ndarray, size: TreeSize, unit: float) -> list[Trees]:
    """One task per step, which has the rows (a bounded number) with that step's residuals."""
    width, bins = usable.shape

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rest = len(r["residuals"]) // steps
                parts = [r["residuals"][s * rest: (s + 1) * rest] for s in range(steps)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(steps), pa.int32()), pa.array([r["bins"]] * steps, pa.binary()),
                     pa.array([r["hashes"]] * steps, pa.binary()), pa.array(parts, pa.binary()),
                     pa.array([r["n"]] * steps, pa.int32())],
                    names=["step", "bins", "hashes", "residuals", "n"])

    def grown(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        step = int(key[0])
        blocks = [_block(*r, width) for r in group[["bins", "hashes", "residuals", "n"]].itertuples(index=False, name=None)]
        block = Block(np.concatenate([b.bins for b in blocks]), np.concatenate([b.hashes for b in blocks]),
                      np.concatenate([b.residuals for b in blocks], axis=1))
        parts = []
        for t in range(size.trees):
            seed = row_seeds(size, t, steps)[step]

            def count(trees: Trees, level: int, slots: np.ndarray, block=block, seed=seed):
                return _sums(iter([block]), trees, level, slots, [seed], size.rows, unit, width, bins)[0]

            made = _grow(count, drawn_columns(size, t, steps, width)[step: step + 1], usable, size, unit)
            block = _lowered(block, made, size.depth)
            parts.append((step, t, made.feature.tobytes(), made.cut.tobytes(), made.value.tobytes()))
        return pd.DataFrame(parts, columns=["step", "tree", "feature", "cut", "value"])

    rows = packed.mapInArrow(dealt, "step int, bins binary, hashes binary, residuals binary, n int")
    # A range per step: tasks of a grouping by hash would be few, as Spark joins small ones.
    spread = rows.repartitionByRange(steps, "step")
    found = spread.groupBy("step").applyInPandas(grown, "step int, tree int, feature binary, cut binary, value binary")
    rounds = [Trees.empty(steps, size.depth) for _ in range(size.trees)]
    for r in found.collect():  # one row per tree
        made = rounds[r["tree"]]
        made.feature[r["step"]] = np.frombuffer(r["feature"], np.int32)
        made.cut[r["step"]] = np.frombuffer(r["cut"], np.int32)
        made.value[r["step"]] = np.frombuffer(r["value"])
    return rounds


def fit_trees(
    df: DataFrame, features: str = "features", labels: str = "future", size: TreeSize = TreeSize()
) -> Ensemble:
    """Boosted trees for every entry of the ``labels`` array (squared error).

    ``df``: two columns of arrays of doubles without missing values, all of one length.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.select(features, labels).persist(StorageLevel.MEMORY_AND_DISK)
    first = kept.first()
    if first is None:
        raise ValueError("no rows to fit")
    width, steps = len(first[0]), len(first[1])
    means = kept.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(labels)[s]).alias(f"m{s}") for s in range(steps)]).first()
    n, base = means["n"], np.array(means[1:], dtype=np.float64)
    reach = kept.agg(*[F.max(F.abs(F.col(labels)[s] - F.lit(float(base[s])))) for s in range(steps)]).first()
    most = max(reach)
    edges = quantile_edges(kept, features, width, size.bins)
    bins = max(map(len, edges)) + 1
    usable = np.arange(bins)[None, :] < np.array([len(e) for e in edges])[:, None]
    # Sums of n residuals stay below 2^SUM_BITS; residuals may double in the course of boosting.
    bits = SUM_BITS - 1 - np.ceil(np.log2(most)) - np.ceil(np.log2(n + 1)) if most else 0.0
    unit = 2.0 ** min(bits, 900.0)
    parts = max(1, min(n // TASK_ROWS, max(spark.sparkContext.defaultParallelism // 2, n // 1_000_000)))
    dealt = kept.coalesce(parts) if kept.rdd.getNumPartitions() >= parts else kept.repartition(parts)
    packed = _packed(dealt, features, labels, edges, base)
    grow = _in_tasks if n <= IN_TASK_ROWS else _in_passes
    try:
        rounds = grow(packed, steps, usable, size, unit)
    finally:
        kept.unpersist()
    shape = (steps, size.trees, 2 ** (size.depth + 1) - 1)
    feature = np.stack([r.feature for r in rounds], axis=1) if rounds else np.full(shape, -1, np.int32)
    cut = np.stack([r.cut for r in rounds], axis=1) if rounds else np.zeros(shape, np.int32)
    value = np.stack([r.value for r in rounds], axis=1) if rounds else np.zeros(shape)
    limits = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        limits[f, : len(e)] = e
    threshold = np.where(feature >= 0, limits[np.maximum(feature, 0), cut], 0.0)
    return Ensemble(base, feature, threshold, value)


def predicted(ensemble: Ensemble, features: Column) -> Column:
    """An array with one prediction per step, in Arrow batches; the model travels with the task."""

    @F.pandas_udf("array<double>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 0))
            yield pd.Series(list(ensemble.predict(x)))

    return walk(features)
