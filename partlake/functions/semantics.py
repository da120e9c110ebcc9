"""Arithmetic in which unknown is never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def least_known(*columns: Column) -> Column:
    """The least value; null if any is null (F.least skips nulls)."""
    return F.when(known(*columns), F.least(*columns))


def greatest_known(*columns: Column) -> Column:
    """The greatest value; null if any is null."""
    return F.when(known(*columns), F.greatest(*columns))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def whole_up(x: Column) -> Column:
    """The next whole number up."""
    return F.ceil(x).cast("long")


def text_equal_numbers(a: Column, b: Column) -> Column:
    """Whether two texts are the same number, or the same text where they are not numbers; null if either is null."""
    x, y = F.trim(a).try_cast("decimal(38,10)"), F.trim(b).try_cast("decimal(38,10)")
    return F.when(known(x, y), x == y).otherwise(F.trim(a) == F.trim(b))


def month(day: Column) -> Column:
    return F.trunc(day, "month")


def month_number(day: Column) -> Column:
    """Months since year 0, so that differences are whole months."""
    return F.year(day) * 12 + F.month(day) - 1


def bucket_labels(limits: tuple[int, ...]) -> list[str]:
    lows = [0, *(x + 1 for x in limits[:-1])]
    return [f"{a}-{b}" for a, b in zip(lows, limits)] + [f"{limits[-1]}+"]


def aging_bucket(days: Column, limits: tuple[int, ...] = (15, 30, 45, 60)) -> Column:
    """The label of an age in days: negative ages are 0, null stays null."""
    labels = bucket_labels(limits)
    out = F.when(days.isNull(), F.lit(None).cast("string"))
    for limit, label in zip(limits, labels):
        out = out.when(days <= limit, label)
    return out.otherwise(labels[-1])


def aging_band(days: Column, fast: int, slow: int) -> Column:
    """FAST, SLOW or NON_MOVING; never moved is NON_MOVING."""
    return F.when(days <= fast, "FAST").when(days <= slow, "SLOW").otherwise("NON_MOVING")


def overdue_state(due: Column, as_of: Column, grace: int) -> Column:
    return F.when(due.isNull(), "NO_DUE_DATE").when(as_of > F.date_add(due, grace), "OVERDUE").otherwise("ON_TIME")


def lead_time_state(elapsed: Column, lead_time: Column) -> Column:
    usable = elapsed.isNotNull() & (lead_time > 0)
    return F.when(~F.coalesce(usable, F.lit(False)), "NO_LEAD_TIME").when(elapsed > lead_time, "BEYOND_LEAD_TIME").otherwise("WITHIN_LEAD_TIME")
