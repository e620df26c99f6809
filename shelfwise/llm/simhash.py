"""SimHash near-duplicates through the segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the number of set
bits per segment. The Manhattan distance of two embeddings never exceeds the Hamming distance
of the fingerprints. So fingerprints within 3 bits have embeddings within 3, and one of the
two halves (16 segments each) within 1. Every half is a cell of a grid: a fingerprint lies in
its own cell of either half, and visits the cells next to it (distance 1). Neighbouring cells
differ in parity, hence only fingerprints of odd parity visit. In each cell, residents are
compared with residents and visitors, and the Hamming distance is verified exactly.

What a cell returns is a spanning forest of its links, never its pairs, so rows stay in
proportion to the input; components are the same. Cells with more than ``hot_cell`` rows are
split into blocks and compared block against block in separate tasks, so that no task holds a
large cell and no pair is lost. Equal fingerprints are merged before all this.

Components: alternating large-star and small-star steps over the links (a constant number of
rows per link), until nothing changes; every step is written to the checkpoint folder.

``first_of_each`` keeps one row of every component, decided on narrow rows: the row with the
smallest key of each fingerprint is found first, then the smallest of each component.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other;
repeated rows share a component; a null key gets a component but never names one (the component
of null keys alone is null); an empty table gives an empty result; input columns named like a
result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import fresh, put, stored, utf8

SHINGLE = 3
MAX_BITS = 3
SEED = 42
HOT_CELL = 20_000
_FIELDS = 0x55555555


def shingle_hashes(body: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle; the whole sequence if it has fewer words."""
    words = body.lower().split()  # A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def fingerprint(body: bytes, size: int = SHINGLE) -> int:
    """The SimHash as a signed 64-bit number; zero without words."""
    hashes = shingle_hashes(body, size)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i: i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    @F.pandas_udf("bigint")
    def hashed(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(b, size) for b in utf8(batch)], dtype="int64")

    return hashed(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def embedding(part: Column) -> Column:
    """Set bits of each two-bit segment of a part of up to 32 bits, as two-bit fields."""
    low = F.lit(_FIELDS)
    return part.bitwiseAND(low) + F.shiftrightunsigned(part, 1).bitwiseAND(low)


def grid(fps: DataFrame) -> DataFrame:
    """Rows (cell, resident, fp): own cells, and for odd parity the cells next to it.

    Fingerprints that differ in up to 3 bits meet in a cell of some half.
    """
    fp = F.col("fp")
    mask = F.lit((1 << 32) - 1)
    cut = fps.select("fp", F.posexplode(F.array(*[
        F.shiftrightunsigned(fp, 32 * i).bitwiseAND(mask) for i in range(2)])).alias("part", "bits"))
    cut = cut.select("fp", "part", embedding(F.col("bits")).alias("own"),
                     (F.bit_count("bits") % 2).alias("odd"))
    field = lambda i: F.expr(f"shiftright(own, {i})").bitwiseAND(F.lit(3))
    ups = F.array_compact(F.array(*[
        F.when(field(2 * i) < 2, F.col("own") + F.lit(1 << 2 * i)) for i in range(16)]))
    downs = F.array_compact(F.array(*[
        F.when(field(2 * i) > 0, F.col("own") - F.lit(1 << 2 * i)) for i in range(16)]))
    visits = F.when(F.col("odd") == 1, F.concat(ups, downs)).otherwise(
        F.array().cast("array<bigint>"))
    every = F.concat(F.array(F.struct(F.col("own").alias("cell"), F.lit(True).alias("resident"))),
                     F.transform(visits, lambda c: F.struct(c.alias("cell"), F.lit(False).alias("resident"))))
    return cut.select("fp", "part", F.explode(every).alias("c")).select(
        (F.col("c.cell") * 2 + F.col("part")).alias("cell"), F.col("c.resident").alias("resident"), "fp")


def forest(x: np.ndarray, residents: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (up to ``bits`` different) of the first ``residents`` with all of ``x``."""
    label = np.arange(len(x))
    for i in range(residents):
        near = np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= bits) + i + 1
        if len(near):
            met = np.unique(np.append(label[near], label[i]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    linked = np.flatnonzero(label != np.arange(len(x)))
    return x[linked], x[label[linked]]


def cell_links(bits: int):
    """Links of all cells of a partition that is sorted by its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        last = False
        while not last:
            batch = next(batches, None)
            last = batch is None
            new = [] if last else [np.stack([
                c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])]
            have = ([rest] if rest is not None else []) + new
            if not have:
                return
            rows = np.concatenate(have, axis=1)
            keys = rows[:3]
            edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            starts = np.concatenate([[0], edge])
            ends = np.concatenate([edge, [rows.shape[1]]])
            if not last:
                rest = rows[:, starts[-1]:]
                starts, ends = starts[:-1], ends[:-1]
            if not len(starts):
                continue
            residents = np.add.reduceat(rows[4, : ends[-1]], starts)
            a, b = [], []
            for k in np.flatnonzero((ends - starts > 1) & (residents > 0)):
                part = rows[:, starts[k]: ends[k]]
                part = part[:, np.argsort(-part[4], kind="stable")].view(np.uint64)
                one, two = forest(part[3], int(residents[k]), bits)
                a.append(one)
                b.append(two)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))],
                    names=["a", "b"])

    return run


def links(fps: DataFrame, bits: int = MAX_BITS, hot_cell: int = HOT_CELL) -> DataFrame:
    """Links (a, b) that connect exactly what pairs of the distinct ``fp`` within ``bits`` connect."""
    if bits > 3:
        raise ValueError("two halves find up to 3 bits")
    rows = grid(fps)
    hot = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_cell)
    hot = hot.select("cell", F.ceil(F.col("n") / hot_cell).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = rows.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.select("cell", "fp", "resident", own.alias("own"), other.alias("other")).select(
        "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp",
        F.col("resident").cast("int").alias("resident"))
    dealt = spread.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    return dealt.mapInArrow(cell_links(bits), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links; root is the smallest node it is linked to.

    Large-star: every node passes its smallest neighbour on to its larger ones. Small-star:
    every node links its smaller ones and itself to the smallest. Both keep components.
    """
    now = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        ).select("x.a", "x.b").where("a <> b").distinct()
        now = stored(small)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _rooted(distinct: DataFrame, bits: int) -> DataFrame:
    """Distinct fingerprints with the smallest fingerprint of their component in ``root``."""
    roots = components(links(distinct.select("fp"), bits))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").drop("node").withColumn(
        "root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE,
    bits: int = MAX_BITS, keep: list[str] | None = None,
) -> DataFrame:
    """All rows with fingerprint (hex) and component_id (smallest key reachable).

    ``keep`` names the input columns of the result (default: all but those replaced).
    """
    kept = [c for c in (docs.columns if keep is None else keep)
            if c.lower() not in ("fingerprint", "component_id")]
    ids = stored(docs.select(
        F.col(f"`{key}`").alias("id"), fingerprints(F.col(f"`{text}`"), size).alias("fp")))
    distinct = stored(ids.groupBy("fp").agg(F.min("id").alias("id")))
    member = _rooted(distinct, bits)
    named = member.groupBy("root").agg(F.min("id").alias("component_id"))
    of = member.join(named, "root").select("fp", "component_id")
    if keep is not None and set(kept) <= {key}:
        rows = ids.withColumnRenamed("id", key)
        rows = rows if kept else rows.drop(key)
        joined = rows.join(of, "fp")
    else:
        own = fresh(docs, "_fp")
        base = docs.select(*[F.col(f"`{c}`") for c in kept],
                           fingerprints(F.col(f"`{text}`"), size).alias(own))
        joined = base.join(of.withColumnRenamed("fp", "_of"), F.col(own) == F.col("_of")).drop("_of")
        return put(joined, {"fingerprint": as_hex(F.col(own))}).drop(own)
    return put(joined, {"fingerprint": as_hex(F.col("fp"))}).drop("fp")


def first_of_each(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bits: int = MAX_BITS,
) -> DataFrame:
    """One row of every component, as it came: the one with the smallest key, nulls last.

    Rows are told apart by all their columns, so different texts under one key, or under none, are
    different rows; of equal keys the row with the smaller hash stays.
    """
    hashed = F.struct(*[F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in docs.columns]).alias(f"h{i}") for i in range(2)])
    mark = fresh(docs, "_row")
    rows = docs.withColumn(mark, hashed)
    rank = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), F.col(mark).alias("row"))
    narrow = rows.select(fingerprints(F.col(f"`{text}`"), size).alias("fp"), rank.alias("rank"))
    distinct = stored(narrow.groupBy("fp").agg(F.min("rank").alias("rank")))
    stay = _rooted(distinct, bits).groupBy("root").agg(F.min("rank").alias("rank")).select(
        F.col("rank.row").alias("_stay"))
    kept = rows.join(stay, F.col(mark) == F.col("_stay")).drop("_stay")
    one = W.partitionBy(mark).orderBy(mark)  # equal rows: any of them
    return kept.withColumn(fresh(docs, "_n"), F.row_number().over(one)).where(
        F.col(fresh(docs, "_n")) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
