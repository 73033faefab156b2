"""Dates of the audit calendar: next run, occurrence key, SLA hours, variance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n)


def days(n: Column) -> Column:
    return F.make_dt_interval(n)


def next_run(cadence: Column, day_of_week: Column, day_of_month: Column, start: Column) -> Column:
    """Next run at 08:00 after ``start``; the weekly rule lands one day after the named weekday."""
    day, eight = F.date_trunc("day", start).cast("timestamp_ntz"), hours(F.lit(8))
    daily = day + days(F.lit(1)) + eight
    shift = F.pmod(F.coalesce(day_of_week, F.lit(1)) - (F.dayofweek(start) - 1) + 7, F.lit(7)) + 1
    weekly = day + days(shift) + eight
    month = F.date_trunc("month", start).cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), F.lit(1))
    monthly = month + days(F.least(F.coalesce(day_of_month, F.lit(1)), F.lit(28)) - 1) + eight
    later = lambda v, step: F.when(v <= start, v + step).otherwise(v)
    return (
        F.when(cadence == "daily", later(daily, days(F.lit(1)))).when(cadence == "weekly", later(weekly, days(F.lit(7))))
        .when(cadence == "monthly", later(monthly, F.make_ym_interval(F.lit(0), F.lit(1))))
        .otherwise(start + days(F.lit(7))))


def occurrence_key(ts: Column, tz: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), F.coalesce(tz, F.lit("UTC"))), "yyyy-MM-dd'T'HH:mm")


# Hours to resolve a finding, by severity.
SLA_HOURS = {"critical": 4, "high": 12, "medium": 24}


def sla_hours(severity: Column, override: Column | None = None) -> Column:
    base = F.when(severity == "critical", SLA_HOURS["critical"]).when(severity == "high", SLA_HOURS["high"]).when(
        severity == "medium", SLA_HOURS["medium"]).otherwise(72)
    return F.coalesce(override, base) if override is not None else base


def variance(expected: Column, actual: Column, price: Column) -> tuple[Column, Column, Column]:
    """Quantity, percent (100 when nothing was expected) and value of a counted line, half-up."""
    q = actual - expected
    pct = F.when(actual.isNull(), None).when(expected > 0, F.round((q.cast("decimal(20,6)") / expected) * 100, 2)).when(
        actual == 0, F.lit(0)).otherwise(F.lit(100))
    return q, pct.cast("double"), F.round(q * price.cast("decimal(12,2)"), 2).cast("double")
