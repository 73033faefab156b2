"""Sliced as-of values and the rolling allowance against plain walks."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import lifecycle as LC
from shelfwright.operators import slices

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seconds", [60, 3600, 10 ** 7])
def test_trend(spark, seconds):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 1, 2, 3]), r.choice([5, 5, 6]), T0 + dt.timedelta(minutes=r.randint(0, 900)), i, r.choice([None, 1, 2, 9]), r.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "store_id long, sku long, ts timestamp_ntz, seq long, qty int, human boolean")
    got = LC.running_trend(df.where("human"), df.where("NOT human"), 2, seconds)
    want, last = [], {}
    for s, k, ts, i, q, human in sorted(rows, key=lambda x: (x[2], x[5], x[3])):
        h, a = last.get((s, k), (None, None))
        if human:
            want.append((s, k, ts, i, q, h, a, None if q is None or a is None else abs(q - a) > 2))
            h = h if q is None else q
        else:
            a = a if q is None else q
        last[s, k] = (h, a)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def walk(times, limit, hours, now):
    n, start, blocked = 0, None, False
    for ts in sorted(times):
        if blocked or (start is not None and ts < start):
            continue
        n += 1
        if n == limit:
            start = ts + dt.timedelta(hours=hours)
            blocked = now < start
            n = n if blocked else 0
    return (limit if blocked else n, blocked, start if blocked else None)


@pytest.mark.parametrize("seconds", [600, 6 * 3600])
def test_allowance(spark, seconds):
    """A hot organisation with a third of all rows, ties, long gaps, and ones that never fill a batch."""
    r = random.Random(9)
    rows = [(r.choice([1] * 15 + list(range(2, 40))), T0 + dt.timedelta(minutes=r.choice([r.randint(0, 20000), 10 * r.randint(0, 90)]))) for _ in range(1500)] + [(99, T0)] * 7 + [(None, T0), (5, None)]
    now = T0 + dt.timedelta(days=10)
    got = slices.allowance(spark.createDataFrame(rows, "org_id long, ts timestamp_ntz"), 5, 24, now, seconds).collect()
    by: dict = {}
    for o, ts in rows:
        if o is not None and ts is not None:
            by.setdefault(o, []).append(ts)
    assert sorted(map(tuple, got)) == sorted((o, *walk(t, 5, 24, now)) for o, t in by.items())
    plan = slices.allowance(spark.createDataFrame(rows, "org_id long, ts timestamp_ntz"), 5, 24, now)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_first_from(spark):
    e = spark.createDataFrame([(1, T0 + dt.timedelta(hours=h), i) for i, h in enumerate((0, 1, 1, 5, 30))], "k long, ts timestamp_ntz, i long")
    asked = spark.createDataFrame([(1, 10 + h, T0 + dt.timedelta(hours=h)) for h in (0, 1, 2, 6, 30, 31)], "k long, src long, at timestamp_ntz")
    got = {r.src - 10: r.i for r in slices.first_from(e, asked, "k", 3600).select("src", "i").collect()}
    assert got == {0: 0, 1: 1, 2: 3, 6: 4, 30: 4, 31: None}
    assert slices.numbered(e.select("k", "ts"), "k", 3600).where(F.col("n") == 5).count() == 5
