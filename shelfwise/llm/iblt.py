"""Document fingerprints by invertible Bloom lookup sketches (DataFrame functions only).

A text is a set of paragraphs: its lines, long ones in pieces of ``piece`` characters, each as
a 64-bit digest. A sketch has three tables of cells; a digest goes into one cell of each. A
cell holds the number of its digests, their XOR and the XOR of their check hashes. Two
versions' sketches are subtracted cell by cell: common digests cancel. A cell left with one
digest (its check hash fits) is pure: the digest is recovered and taken out of its other two
cells, which makes further cells pure. Rounds go over the three tables in turn, as a table
holds a digest only once. If cells remain after ``rounds``, that pair is tried again with a
sketch twice as large and other hash functions, until all are recovered.

Likeness is the Jaccard index that the recovered differences and the two set sizes give.
The fingerprint is the MD5 of a small sketch of the text (4 cells a table).

Cells are made where the digests lie: rows are dealt out by pair once, and exploding,
summing and peeling stay in that partition.

Defined cases: a null text is empty; two texts without paragraphs have likeness 1; repeated
paragraphs count once; an empty table gives an empty result; repeated rows are rows of their
own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

PIECE = 80
#: Cells per digest of both versions together; grows twofold with each attempt.
CELLS = 1.5
ROUNDS = 14
ATTEMPTS = 12
_CHECK = 7


def paragraphs(text: Column, piece: int = PIECE) -> Column:
    """Distinct digests of a text's paragraphs."""
    cut = F.lit(rf"[^\n]{{0,{piece}}}\n|[^\n]{{1,{piece}}}")
    return F.array_distinct(F.transform(
        F.regexp_extract_all(text, cut, F.lit(0)), lambda x: F.xxhash64(x)))


def base_fingerprint(keys: Column, cells: int = 4) -> Column:
    """MD5 of the sketch with three tables of ``cells`` cells."""
    def cell(t: int, i: int) -> Column:
        inside = F.filter(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(t)), F.lit(cells)) == i)
        xor = F.aggregate(inside, F.lit(0).cast("bigint"), lambda s, k: s.bitwiseXOR(k))
        return F.concat(F.hex(F.size(inside)), F.lit(":"), F.hex(xor))

    return F.md5(F.concat_ws(",", *[cell(t, i) for t in range(3) for i in range(cells)]).cast("binary"))


def _place(key: Column, t: int, seed: int, width: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed * 3 + t)), width) + width * t


def _summed(cells: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.groupBy(*keys, "pos").agg(
        F.sum("cnt").alias("cnt"), F.bit_xor("kx").alias("kx"), F.bit_xor("cx").alias("cx"))
    return out.where("cnt <> 0 or kx <> 0 or cx <> 0")


def difference(pairs: DataFrame, cells: float = CELLS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """Per pair (id, kind, left, right) the recovered differences of two digest sets.

    Result: id, kind, only_left, only_right, stuck (cells that could not be peeled). Pairs
    without any difference have no row.
    """
    width = F.ceil((F.size("left") + F.size("right")) * cells / 3).cast("bigint") + 4
    signed = F.concat(
        F.transform("left", lambda k: F.struct(k.alias("k"), F.lit(1).cast("bigint").alias("s"))),
        F.transform("right", lambda k: F.struct(k.alias("k"), F.lit(-1).cast("bigint").alias("s"))))
    keys = ["id", "kind", "width"]
    items = pairs.select("id", "kind", width.alias("width"), F.explode(signed).alias("e")).select(
        *keys, "e.k", "e.s")
    placed = items.select(*keys, "k", "s", F.xxhash64("k", F.lit(_CHECK)).alias("c"), F.explode(
        F.array(*[_place(F.col("k"), t, seed, F.col("width")) for t in range(3)])).alias("pos"))
    now = _summed(placed.select(
        *keys, "pos", F.col("s").alias("cnt"), F.col("k").alias("kx"), F.col("c").alias("cx")), keys)
    zero = F.lit(0).cast("bigint")

    def cell(pos: Column, cnt: Column, kx: Column, cx: Column) -> Column:
        return F.struct(pos.cast("bigint").alias("pos"), cnt.alias("cnt"), kx.alias("kx"), cx.alias("cx"))

    for r in range(rounds):
        t = r % 3
        cnt, kx, cx, w = F.col("cnt"), F.col("kx"), F.col("cx"), F.col("width")
        pure = ((F.col("pos") >= w * t) & (F.col("pos") < w * (t + 1)) & (F.abs(cnt) == 1)
                & (F.xxhash64(kx, F.lit(_CHECK)) == cx))
        taken = F.array(
            cell(F.when(cnt == 1, F.lit(-1)).otherwise(F.lit(-2)), F.lit(1).cast("bigint"), zero, zero),
            *[cell(_place(kx, u, seed, w), -cnt, kx, cx) for u in range(3) if u != t])
        kept = F.array(cell(F.col("pos"), cnt, kx, cx))
        now = now.select(*keys, F.explode(F.when(pure, taken).otherwise(kept)).alias("x")).select(
            *keys, "x.pos", "x.cnt", "x.kx", "x.cx")
        now = _summed(now, keys)
    one = lambda p: F.coalesce(F.sum(F.when(F.col("pos") == p, F.col("cnt"))), zero)
    return now.groupBy("id", "kind").agg(
        one(-1).alias("only_left"), one(-2).alias("only_right"),
        F.count(F.when(F.col("pos") >= 0, 1)).alias("stuck"))


def likeness(pairs: DataFrame, cells: float = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(id, kind, likeness) for rows (id, kind, left, right); tried again until all peel.

    ``pairs`` should be stored: each attempt reads it.
    """
    sizes = pairs.select("id", "kind", F.size("left").alias("l"), F.size("right").alias("r"))
    done, todo = None, pairs
    for attempt in range(ATTEMPTS):
        dealt = todo.repartition("id")
        found = stored(difference(dealt, cells * 2**attempt, rounds + 6 * attempt, attempt + 1))
        good = found.where("stuck = 0")
        done = good if done is None else done.unionByName(good)
        failed = found.where("stuck > 0").select("id", "kind")
        if failed.isEmpty():
            break
        todo = pairs.join(failed, ["id", "kind"], "left_semi")
    else:
        raise ArithmeticError(f"sketches not peeled after {ATTEMPTS} attempts")
    both = F.col("l") - F.col("only_left")
    every = F.col("l") + F.col("only_right")
    return sizes.join(done, ["id", "kind"], "left").fillna(0, ["only_left", "only_right"]).select(
        "id", "kind", F.when(every == 0, F.lit(1.0)).otherwise(both / every).alias("likeness"))
