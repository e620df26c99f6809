"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies: the source's target
divided by its size. The expected copies are added up along a fixed order within the source,
one random offset per source is added, and a document is emitted once for every integer that
its step crosses. So a document is taken floor(rate) or ceil(rate) times, and any run of
neighbours is taken as often as its share says, up to one copy. The order runs by size, so
the words taken follow the target about as closely as the number of documents does.

The running sum needs no task that holds a whole source: documents lie in blocks of one
source, one size class and one hash class; blocks are counted first, their offsets are added
up over the (small) block table, and only positions within a block are counted by a window.
All sums are integers in units of 2^-24 copies, hence exact and equal on every rerun.

Defined cases: a null source is a source of its own, after all others; a null text has size
0; a source of size 0 has target 0 and gives nothing; repeated rows are documents of their
own; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD, put, stored, texts

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents of one block at most, about; a block is what one window group holds.
BLOCK_ROWS = 100_000
UNIT_BITS = 24
_KEY = ("_source", "_no_source", "_octave", "_head", "_sub")


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _digits(text: Column) -> Column:
    """24 even bits from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """Targets of all sources; ``sizes`` has one row per source: _source, _no_source, size.

    The whole size is shared by weight. A source's target stops at ``max_copies`` times its
    size; what is above goes to the others by weight. In the order of that limit per weight a
    source is capped exactly if, with all before it capped, its share still reaches the limit.
    """
    order = W.orderBy("_no_source", "_source")
    ranked = sizes.withColumn("_rank", F.row_number().over(order)).withColumn(
        "_weight",
        F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]),
                     ((F.col("_rank") - 1) % len(weights) + 1).cast("int")),
    ).withColumn("_cap", F.col("source_size") * max_copies)
    whole = W.partitionBy(F.lit(0))
    before = whole.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(
        W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    walked = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("_all"),
        F.sum("_weight").over(whole).alias("_weights"),
        F.coalesce(F.sum("_cap").over(before), zero).alias("_capped_size"),
        F.coalesce(F.sum("_weight").over(before), zero).alias("_capped_weight"),
    ).withColumn(
        "_capped",
        F.col("_cap") * (F.col("_weights") - F.col("_capped_weight"))
        <= (F.col("_all") - F.col("_capped_size")) * F.col("_weight"),
    )
    left = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(whole), zero)
    shares = F.col("_weights") - F.coalesce(
        F.sum(F.when(F.col("_capped"), F.col("_weight"))).over(whole), zero)
    return walked.select(
        "_source", "_no_source", "source_size",
        F.when(F.col("_capped"), F.col("_cap").cast("double"))
        .otherwise(F.col("_weight") * (left / shares)).alias("target"),
    ).withColumn(
        "_units",
        F.when(F.col("source_size") > 0,
               F.round(F.col("target") / F.col("source_size") * 2**UNIT_BITS))
        .otherwise(F.lit(0)).cast("bigint"),
    )


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    block_rows: int = BLOCK_ROWS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every document with size, source_size, target, copies and taken (copies times size).

    ``keep`` names the input columns that the result has (default: all). Only they, and
    nothing else of the text, are shuffled, once.
    """
    body, origin = F.col(f"`{text}`"), F.col(f"`{source}`")
    blocks = max(1, -(-docs.count() // block_rows))
    ident = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    kept = docs.columns if keep is None else list(keep)
    sized = docs.select(
        *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)],
        F.col(f"`{key}`").alias("_key"),
        words(body).alias("size"),
        F.coalesce(origin, F.lit("")).alias("_source"),
        origin.isNull().alias("_no_source"),
        (_digits(ident) % blocks).alias("_sub"),
        F.md5(texts(body).cast("binary")).alias("_tie"),
    ).withColumns({
        "_octave": F.length(F.bin("size")),
        "_head": F.substring(F.bin("size"), 1, 4),
    })
    counted = stored(sized.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_words")))
    targets = source_targets(
        counted.groupBy("_source", "_no_source").agg(F.sum("_words").alias("source_size")),
        weights, max_copies,
    )
    classes = counted.groupBy(*_KEY[:4]).agg(F.sum("_rows").alias("_class_rows"))
    along = W.partitionBy("_source", "_no_source").orderBy("_octave", "_head").rowsBetween(
        W.unboundedPreceding, -1)
    within = W.partitionBy(*_KEY[:4]).orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = stored(
        counted.withColumn("_before", F.coalesce(F.sum("_rows").over(within), zero))
        .join(classes.withColumn(
            "_classes_before", F.coalesce(F.sum("_class_rows").over(along), zero)), list(_KEY[:4]))
        .join(targets, ["_source", "_no_source"])
        .select(*_KEY, "source_size", "target", "_units",
                ((F.col("_before") + F.col("_classes_before")) * F.col("_units")).alias("_start"))
    )
    order = W.partitionBy(*_KEY).orderBy("size", "_key", "_tie").rowsBetween(
        W.unboundedPreceding, 0)
    upto = F.col("_start") + F.sum("_units").over(order) + _digits(F.col("_source"))
    found = (
        sized.join(offsets, list(_KEY))
        .withColumn("_upto", upto)
        .withColumn("copies", F.shiftright("_upto", UNIT_BITS)
                    - F.shiftright(F.col("_upto") - F.col("_units"), UNIT_BITS))
    )
    names = ("size", "source_size", "target", "copies")
    rows = found.select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept) if c.lower() not in (*names, "taken")],
        *names, (F.col("copies") * F.col("size")).alias("taken"),
    )
    return rows


def repeated(docs: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as ``copies`` says."""
    spread = F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))
    return put(docs, {"_copy": spread}).drop("_copy")
