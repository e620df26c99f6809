"""Nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables has ``hashes`` Gaussian projections, shifted and cut into slabs
of one width; the slab numbers are a bucket. Every vector lies in one bucket per table. A query
visits the ``probes`` buckets per table that most likely hold a neighbour: in the order of the
squared distances from its projections to the buckets' slabs. What the tables' buckets hold is
merged and ranked by the exact distance on the original vectors.

Width and number of probes are set on a bounded sample (``sample`` vectors): the fewest probes
whose recall there, measured against brute force, reaches ``recall``. The sample is sparser
than the table, so neighbours are further apart in it and the choice is on the safe side. Every
row is indexed.

Equal vectors share their fate, so only the k + 1 smallest ids of each are indexed, and equal
queries are searched once; no copy within the first k is lost. Buckets with more than
``hot_bucket`` rows are split by id, and their probes visit every part. Queries that find fewer
than k rows are compared with all rows, in blocks of queries.

Defined cases: vectors that are null, zero, of another length than most, or with null or
non-finite components take no part, nor do rows without id; ties go to the smaller id; fewer
than k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

TABLES = 4
HASHES = 5
#: Slab width in units of the median distance of two sampled vectors over the root of two.
WIDTH = 1.5
SAMPLE = 2_000
RECALL = 0.96
HOT_BUCKET = 50_000
REACH = 3
#: Buckets that a query visits per table at most; beyond, the index takes fewer hashes.
MOST_PROBES = 1_024
QUERY_BLOCK = 2_000
_BITS = 12


@dataclass(frozen=True)
class Index:
    """Projections (d x tables*hashes), shifts and slab width; number of probes per table."""

    planes: np.ndarray
    shifts: np.ndarray
    width: float
    tables: int
    hashes: int
    probes: int

    def slabs(self, x: np.ndarray) -> np.ndarray:
        """Position in slab widths: n x tables x hashes."""
        return ((x @ self.planes + self.shifts) / self.width).reshape(len(x), self.tables, self.hashes)

    def codes(self, slab: np.ndarray) -> np.ndarray:
        """Bucket numbers of whole slab numbers (..., tables, hashes)."""
        half = 1 << (_BITS - 1)
        cells = np.clip(slab, -half, half - 1).astype(np.int64) + half
        code = np.arange(self.tables, dtype=np.int64) * np.ones(cells.shape[:-1], dtype=np.int64)
        for j in range(self.hashes):
            code = (code << _BITS) | cells[..., j]
        return code

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return self.codes(np.floor(self.slabs(x)))

    def visits(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Buckets of each query in estimated success order: n x tables x probes."""
        probes = probes or self.probes
        place = self.slabs(x)
        home = np.floor(place)
        steps = np.array(list(itertools.product(range(-REACH, REACH + 1), repeat=self.hashes)))
        offsets = np.arange(-REACH, REACH + 1)
        inside = (place - home)[..., None]
        gap = np.where(offsets == 0, 0.0, np.where(offsets > 0, offsets - inside, inside - offsets - 1)) ** 2
        out = np.empty((len(x), self.tables, min(probes, len(steps))), dtype=np.int64)
        for i in range(len(x)):
            for t in range(self.tables):
                cost = sum(gap[i, t, j][steps[:, j] + REACH] for j in range(self.hashes))
                best = np.argsort(cost, kind="stable")[:probes]
                cells = home[i, t] + steps[best]
                shaped = np.repeat(cells[:, None, :], self.tables, axis=1)
                out[i, t] = self.codes(shaped)[:, t]
        return out


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distance of one vector to others, in double precision."""
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the k nearest rows (ids and distances), ties to the smaller id."""
    norms = (x * x).sum(axis=1)
    for a in range(0, len(q), 64):
        part = q[a: a + 64]
        rough = norms[None] - 2.0 * part @ x.T
        for row, v in zip(rough, part):
            if len(x) > k:
                slack = 1e-9 * (1.0 + float(v @ v) + float(norms.max()))
                near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack)
            else:
                near = np.arange(len(x))
            d = exact(v, x[near])
            order = np.lexsort((ids[near], d))[:k]
            yield ids[near][order], d[order]


def make_index(
    sample: np.ndarray, k: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH,
    recall: float = RECALL, seed: int = 5,
) -> Index:
    """Draw the hashes and choose width and probes on the sample.

    Where the most probes allowed miss the wanted recall, there are fewer hashes per table, whose
    buckets are larger; with one hash per table the search fails instead of missing it silently.
    """
    draw = np.random.default_rng(seed)
    d = sample.shape[1]
    pairs = draw.integers(0, len(sample), size=(2, 4_000))
    far = exact(np.zeros(d), sample[pairs[0]] - sample[pairs[1]])
    typical = float(np.median(far[far > 0])) / np.sqrt(2.0) if (far > 0).any() else 1.0
    size = width * typical
    index = Index(draw.normal(size=(d, tables * hashes)), draw.uniform(0, size, tables * hashes),
                  size, tables, hashes, 1)
    most = (2 * REACH + 1) ** hashes
    if len(sample) <= 10 * k:
        return Index(index.planes, index.shifts, size, tables, hashes, min(most, 256))
    asked = np.arange(0, len(sample), max(1, len(sample) // 100))
    own = index.buckets(sample)
    visits = index.visits(sample[asked], min(most, MOST_PROBES))
    place = np.full((len(asked), len(sample)), 1 << 30)
    for i in range(len(asked)):
        for t in range(tables):
            order = np.argsort(visits[i, t], kind="stable")
            at = np.clip(np.searchsorted(visits[i, t][order], own[:, t]), 0, len(order) - 1)
            hit = visits[i, t][order][at] == own[:, t]
            place[i] = np.minimum(place[i], np.where(hit, order[at], 1 << 30))
    needed = []
    for i, a in enumerate(asked):
        dist = exact(sample[a], sample)
        dist[a] = np.inf
        needed.extend(place[i, np.argsort(dist, kind="stable")[:k]] + 1)
    probes = int(np.quantile(needed, recall, method="higher"))
    if probes > min(most, MOST_PROBES):
        if hashes == 1:
            raise ArithmeticError(f"no number of probes reaches a recall of {recall}")
        return make_index(sample, k, tables, hashes - 1, width, recall, seed)
    return Index(index.planes, index.shifts, size, tables, hashes, max(8, probes))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query from (q, vec_id, score) rows."""
    order = W.partitionBy("q").orderBy("score", "vec_id")
    return rows.dropDuplicates(["q", "vec_id"]).withColumn("_r", F.row_number().over(order)).where(
        F.col("_r") <= k).drop("_r")


def _search_buckets(index: Index, d: int, dtype: str, k: int):
    """Merge bucket by bucket; the rows of a partition come sorted by bucket and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            merged: dict[int, list] = {}
            for q, ids, score in found:
                merged.setdefault(q, []).append((ids, score))
            found.clear()
            for q, parts in merged.items():
                ids, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
                score = np.concatenate([p[1] for p in parts])[first]
                order = np.lexsort((ids, score))[:k]
                found.append((q, ids[order], score[order]))
            if all_of_it or sum(len(f[1]) for f in found) > 500_000:
                q = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array(q, pa.int64()),
                    pa.array(np.concatenate([f[1] for f in found] or [[]]), pa.int64()),
                    pa.array(np.concatenate([f[2] for f in found] or [[]]), pa.float64()),
                ], names=["q", "vec_id", "score"])
                found.clear()

        def work(rows: pa.Table) -> None:
            kind = rows.column("probe").to_numpy()
            ids = rows.column("id").to_numpy()
            raw = b"".join(v.as_py() for v in rows.column("v"))
            x = np.frombuffer(raw, dtype=dtype).reshape(-1, d).astype(np.float64)
            inside, asked = kind == 0, kind == 1
            if inside.any() and asked.any():
                hits = nearest(x[asked], x[inside], ids[inside], k)
                found.extend((int(q), i, s) for q, (i, s) in zip(ids[asked], hits))

        rest: pa.Table | None = None
        seen = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                rest = new if rest is None else pa.concat_tables([rest, new])
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([rest.column("bucket").to_numpy(), rest.column("part").to_numpy()])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *edges.tolist(), *([rest.num_rows] if batch is None else [])]
            for a, b in zip(bounds[:-1], bounds[1:]):
                work(rest.slice(a, b - a))
            rest = rest.slice(bounds[-1]) if batch is not None else None
            if len(found) - seen > 50_000:
                yield from flush(False)
                seen = len(found)
        yield from flush(True)

    return run


def _scan(block: list, d: int, dtype: str, k: int):
    """Compare a block of queries with every row of a partition."""
    asked = np.array([q for q, _ in block], dtype=np.int64)
    q = np.frombuffer(b"".join(v for _, v in block), dtype=dtype).reshape(-1, d).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), d).astype(np.float64)
                hits = list(nearest(q, x, batch.column(0).to_numpy(), k))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(asked, [len(h[0]) for h in hits])),
                    pa.array(np.concatenate([h[0] for h in hits])),
                    pa.array(np.concatenate([h[1] for h in hits]))], names=["q", "vec_id", "score"])

    return run


def search(
    vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, sample: int = SAMPLE,
    recall: float = RECALL, hot_bucket: int = HOT_BUCKET, index: Index | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``queries`` marks."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("x"),
                          queries.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x")))
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    picked = rows.orderBy(F.xxhash64("id"), "id").select("x").limit(2 * sample).collect()  # bounded
    if not picked:
        return spark.createDataFrame([], shape)
    lengths = [len(r["x"]) for r in picked]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows = rows.where(F.size("x") == d)
    if index is None:
        few = np.unique(np.array([r["x"] for r in picked if len(r["x"]) == d], dtype=float), axis=0)
        few = few[np.random.default_rng(1).permutation(len(few))[:sample]]
        index = make_index(few, k, tables, hashes, width, recall)
    dtype = "<f4" if rows.schema["x"].dataType.elementType.simpleString() == "float" else "<f8"
    found_shape = "q bigint, vec_id bigint, score double"

    copies = W.partitionBy("x").orderBy("id")
    kept = rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).select("id", "x")
    asked = rows.where("asked").select("id", "x")
    heads = asked.groupBy("x").agg(F.min("id").alias("id"))

    def hashed(probe: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 2_000):
                    part = batch.slice(a, 2_000)
                    x = _matrix(part.column(1), d)
                    code = index.visits(x.astype(np.float64)) if probe else index.buckets(x.astype(np.float64))
                    code = code.reshape(len(x), -1)
                    raw = [v.tobytes() for v in np.ascontiguousarray(x, dtype=dtype)]
                    times = code.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(code.ravel()), pa.array(np.full(code.size, probe, np.int32)),
                        pa.array(np.repeat(part.column(0).to_numpy(), times)),
                        pa.array([v for v in raw for _ in range(times)], pa.binary()),
                    ], names=["bucket", "probe", "id", "v"])

        return run

    bucket_shape = "bucket bigint, probe int, id bigint, v binary"
    inside = kept.select("id", "x").mapInArrow(hashed(0), bucket_shape)
    visits = heads.select("id", "x").mapInArrow(hashed(1), bucket_shape)
    hot = inside.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket).select(
        "bucket", F.ceil(F.col("n") / hot_bucket).cast("int").alias("parts"))
    both = inside.unionByName(visits).join(hot, "bucket", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = both.select("bucket", "probe", "id", "v", F.explode(
        F.when(F.col("probe") == 1, every).otherwise(own)).alias("part"))
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    found = stored(_ranked(dealt.mapInArrow(_search_buckets(index, d, dtype, k + 1), found_shape), k + 1))

    counts = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    lacking = heads.join(counts, heads["id"] == counts["q"], "left").where(
        F.coalesce("n", F.lit(0)) < k + 1).select("id", "x").orderBy("id")
    after = None
    while True:  # blocks of bounded size
        block = (lacking if after is None else lacking.where(F.col("id") > after)).limit(QUERY_BLOCK).collect()
        if not block:
            break
        after = block[-1]["id"]
        raw = [(r["id"], np.array(r["x"], dtype=dtype).tobytes()) for r in block]
        more = kept.mapInArrow(_scan(raw, d, dtype, k + 1), found_shape)
        found = stored(_ranked(found.unionByName(more), k + 1))
        if len(block) < QUERY_BLOCK:
            break

    named = asked.join(heads.select(F.col("id").alias("q"), "x"), "x").select(F.col("id").alias("query_id"), "q")
    mine = named.join(found, "q").where("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return mine.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
