"""Calendar parts of a date as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR_FEATURES = ("dow", "day", "month", "year", "weekofyear", "is_weekend")


def calendar_parts(date: Column) -> dict[str, Column]:
    """Monday is 0; weeks are ISO weeks; Saturday and Sunday are the weekend."""
    return {
        "dow": F.weekday(date),
        "day": F.dayofmonth(date),
        "month": F.month(date),
        "year": F.year(date),
        "weekofyear": F.weekofyear(date),
        "is_weekend": (F.weekday(date) >= 5).cast("int"),
    }


def parse_timestamp(text: Column, formats: Sequence[str] = ()) -> Column:
    """First reading that works: the standard form, then each given pattern; else NULL."""
    attempts = [F.try_to_timestamp(text)]
    attempts += [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*attempts)


def future_dates(last: Column, steps: int, step_days: int = 1) -> Column:
    """The ``steps`` dates after ``last``."""
    return F.sequence(
        F.date_add(last, step_days),
        F.date_add(last, steps * step_days),
        F.expr(f"make_interval(0, 0, 0, {step_days})"),
    )
