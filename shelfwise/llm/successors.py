"""Each row beside the row that follows it in a global order, without one task that sorts all.

Rows lie in blocks of neighbouring keys (bounds from approximate quantiles; they only decide
where a row is worked on, not the result). Within a block a window reads the following row;
the last row of a block gets the first row of the next block, the last of all the first of all.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 2_000


def with_next(
    rows: DataFrame, key: str, tie: Column, carried: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All rows with ``next_<c>`` for each carried column, in descending order of ``key``.

    Null keys come last; equal keys are ordered by ``tie``.
    """
    value = F.col(key).cast("double")
    total = rows.count()
    blocks = max(1, total // block_rows)
    bounds = []
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        bounds = sorted(set(rows.select(value.alias("v")).where("v is not null").approxQuantile(
            "v", shares, 1 / (4 * blocks))))
    spread = rows.withColumn("_v", -value).withColumn("_tie", tie)
    if bounds:
        cuts = [-float("inf"), *sorted(-b for b in bounds), float("inf")]
        bucket = Bucketizer(splits=cuts, inputCol="_v", outputCol="_b", handleInvalid="keep")
        last = F.lit(len(cuts))  # null keys
        spread = bucket.transform(spread).withColumn(
            "_b", F.when(F.col("_v").isNull(), last).otherwise(F.col("_b").cast("int")))
    else:
        spread = spread.withColumn("_b", F.when(F.col("_v").isNull(), 1).otherwise(0))
    order = W.partitionBy("_b").orderBy(F.col(key).desc_nulls_last(), "_tie")
    ahead = F.lead(F.struct(*carried)).over(order)
    walked = spread.select("*", ahead.alias("_next"), F.row_number().over(order).alias("_place"))
    firsts = walked.where("_place = 1").select("_b", F.struct(*carried).alias("_first"))
    along = W.orderBy("_b")
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = firsts.select("_b", F.coalesce(
        F.lead("_first").over(along), F.first("_first").over(whole)).alias("_first"))
    joined = walked.join(firsts, "_b").withColumn("_next", F.coalesce("_next", "_first"))
    return joined.select(*rows.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried])
