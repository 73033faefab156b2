"""Ordered rules give the same rows however events are dealt over batches; state and bytes written stay bounded."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwright.streaming import jobs as J
from shelfwright.streaming import ordered as O

SF = "/root/testdata/sf0.001"
DELAY = 600_000_000


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """The same events: one file; many files in order; many files whose rows are shuffled within the delay."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") % 7)
    r = random.Random(1)
    rows = sorted(events.collect(), key=lambda e: e.ts)
    late = sorted(rows, key=lambda e: e.ts.timestamp() + r.uniform(0, DELAY / 1e6 * 0.95))
    out = []
    for name, order, parts in (("one", rows, 1), ("many", rows, 3), ("late", late, 5)):
        folder = str(tmp_path_factory.mktemp(name))
        size = -(-len(order) // parts)
        for k in range(parts):  # one file after another, so that they are read in this order
            spark.createDataFrame(order[k * size:(k + 1) * size], events.schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        out.append(folder)
    return out


@pytest.mark.parametrize("name", ["rate", "allowance", "overdue", "completions"])
def test_batches_do_not_matter(spark, dealt, name):
    def run(folder):
        e = J.event_stream(spark, folder, files_per_trigger=1)
        if name == "rate":
            out = O.rate_limited(e.select("org_id", "event_id", "ts"), 3, 24 * 3600)
        elif name == "allowance":
            out = O.allowance_stream(e.select("org_id", "event_id", "ts"), 5, 24)
        elif name == "overdue":
            out = O.overdue_timers(e.select("org_id", "event_id", "event_type", "ts"), 24)
        else:
            out = O.completions(e.select("org_id", F.expr("event_id % 40").alias("scan_id"), "event_id", "ts", F.when(F.col("event_type") == "purchase", "completed").otherwise("open").alias("status")))
        return sorted(map(tuple, J.drain(out, "probe").collect()))

    first, *others = [run(f) for f in dealt]
    assert first and all(o == first for o in others)
