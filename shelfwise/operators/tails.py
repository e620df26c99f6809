"""What a series has to remember so that rows posted later can be engineered: its newest rows.

Lags and means of a short batch reach back into earlier rows. A tail holds, per series, the newest
rows within that reach; it grows with the number of series, never with their length. Rows of the
batch are put behind their series' tail, engineered together, and only they are kept. The next tail
are the newest rows of both.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.columns import name
from shelfwise.operators.features import LAGS, ROLLS, with_features
from shelfwise.operators.ordering import AUTO, Layout, last_rows, series_keys, series_order
from shelfwise.operators.roles import Roles

POSTED = "_posted"


def reach(lags: Sequence[int] = LAGS, rolls: Sequence[int] = ROLLS) -> int:
    """How many earlier rows the features of a row look at."""
    return max([*lags, *rolls, 0])


def series_tail(df: DataFrame, roles: Roles, rows: int) -> DataFrame:
    """The newest ``rows`` rows of every series (cut in the map tasks, before the shuffle)."""
    return last_rows(df, roles, rows).drop("_back")


def _places(roles: Roles) -> list[str]:
    return [*roles.keys, *roles.tiebreak]


def _among(left: DataFrame, right: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join on the columns, null being equal to null."""
    keys = right.select(*[name(c).alias(f"_k{i}") for i, c in enumerate(columns)]).distinct()
    same = [name(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)]
    return left.join(keys, reduce(lambda a, b: a & b, same), kind)


def _alike(tail: DataFrame, posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns of both, posted ones in the tail's types."""
    columns = [c for c in tail.columns if c in posted.columns]
    new = posted.select(*[name(c).cast(tail.schema[c].dataType).alias(c) for c in columns])
    return tail.select(*[name(c) for c in columns]), new


def continued(tail: DataFrame, posted: DataFrame, roles: Roles) -> DataFrame:
    """Posted rows with the remembered rows of their series; ``_posted`` tells them apart.

    Columns are those of both. A posted row replaces a remembered one of its key and date, so a
    batch may be posted again. Series without posted rows are left out.
    """
    old, new = _alike(tail, posted)
    if roles.series is not None:
        old = _among(old, new, [roles.series], "left_semi")
    old = _among(old, new, _places(roles), "left_anti")
    return old.withColumn(POSTED, F.lit(False)).unionByName(new.withColumn(POSTED, F.lit(True)))


def next_tail(tail: DataFrame | None, posted: DataFrame, roles: Roles, rows: int) -> DataFrame:
    """The tail after a batch: the newest rows of the old one and the batch, for all series."""
    if tail is None:
        return series_tail(posted, roles, rows)
    old, new = _alike(tail, posted)
    old = _among(old, new, _places(roles), "left_anti")
    return series_tail(old.unionByName(new), roles, rows)


def filled_marks(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows made by filling the calendar take the mark of the row before them in their series."""
    upto = W.partitionBy(*series_keys(roles)).orderBy(*series_order(roles)).rowsBetween(
        W.unboundedPreceding, 0)
    return df.withColumn(POSTED, F.coalesce(F.last(POSTED, ignorenulls=True).over(upto), F.lit(False)))


def posted_features(
    tail: DataFrame | None, posted: DataFrame, roles: Roles, lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS, layout: Layout = AUTO,
) -> DataFrame:
    """All features of the posted rows, as if their series had come in one piece."""
    if tail is None:
        return with_features(posted, roles, lags, rolls, layout)
    framed = with_features(continued(tail, posted, roles), roles, lags, rolls, layout)
    return framed.where(POSTED).drop(POSTED)
