"""Ratios, variances and status expressions; a missing input gives null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def percentage(num: Column, den: Column, decimals: int = 1) -> Column:
    return F.bround(ratio(num, den) * 100.0, decimals)


def percent_or_none(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.bround(num.cast("double") / den.cast("double") * 100.0, 4))


def facing_variance(actual: Column, expected: Column) -> Column:
    return actual - expected


def shortfall(actual: Column, expected: Column) -> Column:
    """Units missing against the plan; unread units count as zero on shelf."""
    return F.when(expected.isNotNull(), F.greatest(expected - F.coalesce(actual, F.lit(0)), F.lit(0)))


def value_gap(short: Column, price: Column) -> Column:
    return F.when(short.isNotNull(), F.bround(F.greatest(short, F.lit(0)) * price, 2))


def coverage_days(actual: Column, daily: Column) -> Column:
    return F.when(daily > 0, F.bround(actual / daily, 1))


def min_max_status(actual: Column, low: Column, high: Column) -> Column:
    both = low.isNotNull() & high.isNotNull()
    return (
        F.when(actual.isNull(), "UNVERIFIABLE")
        .when(low.isNull() & high.isNull(), "NO_RANGE")
        .when(low.isNotNull() & (actual < low), "BELOW_MIN")
        .when(high.isNotNull() & (actual > high), "ABOVE_MAX")
        .when(both, "WITHIN_RANGE")
        .when(low.isNotNull(), "MEETS_MIN")
        .otherwise("WITHIN_MAX")
    )


def count_int(cond: Column) -> Column:
    """Conditional count that is 0, not null, on a group without hits."""
    return F.count_if(cond)


def money(col: Column) -> Column:
    """Exact fixed-point money, so that sums do not depend on row order."""
    return col.cast("decimal(18,2)")
