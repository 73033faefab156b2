"""As-of values over slices of time: what a slice ends with is carried into the later ones, so that no key is one task."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.session import cut_lineage

SALTS = 8


def slice_of(ts: Column, seconds: int) -> Column:
    """Number of the slice of time that holds ``ts`` (timestamps with or without zone; the session's zone is taken for both)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def carried(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, bool]], seconds: int, ts: str = "ts") -> DataFrame:
    """Add the last non-null value of a column among the earlier rows of its key.

    ``values``: new column -> (column, whether the row itself counts). Rows are windowed inside (key, slice); the last values
    of slices, one row each, are carried over empty and full slices by a window over the slices of a key.
    """
    d = rows.withColumn("slice", slice_of(F.col(ts), seconds))
    ends = d.groupBy(*keys, "slice").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"end_{n}") for n, (c, _) in values.items()])
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "slice", *[F.last(f"end_{n}", ignorenulls=True).over(over).alias(f"from_{n}") for n in values])
    w = Window.partitionBy(*keys, "slice").orderBy(*order)
    frame = lambda itself: w.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    same = None
    for k in [*keys, "slice"]:
        one = d[k].eqNullSafe(ends[k])
        same = one if same is None else same & one
    j = d.join(ends, same).select(d["*"], *[ends[f"from_{n}"] for n in values])
    return j.select(*rows.columns, *[F.coalesce(F.last(c, ignorenulls=True).over(frame(itself)), F.col(f"from_{n}")).alias(n) for n, (c, itself) in values.items()])


def numbered(events: DataFrame, key: str, seconds: int, ts: str = "ts") -> DataFrame:
    """``events`` with ``i``, the place of a row among those of its key by time, and ``n``, their number."""
    d = events.withColumn("slice", slice_of(F.col(ts), seconds))
    counts = d.groupBy(key, "slice").agg(F.count("*").alias("here"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "slice", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("shift"), F.sum("here").over(Window.partitionBy(key)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "slice").orderBy(ts)) - 1
    return d.withColumn("place", place).join(counts, [key, "slice"]).select(*events.columns, (F.col("shift") + F.col("place")).alias("i"), "n")


def first_from(events: DataFrame, asked: DataFrame, key: str, seconds: int) -> DataFrame:
    """``asked`` (key, src, at) with ``i``, the place of the first of ``events`` (key, ts, i) at or behind ``at``; null where there is none."""
    both = (events.select(key, F.col("ts").alias("at"), "i", F.lit(None).cast("long").alias("src"))
            .unionByName(asked.select(key, "at", F.lit(None).cast("long").alias("i"), "src")).withColumn("slice", slice_of(F.col("at"), seconds)))
    firsts = both.groupBy(key, "slice").agg(F.min("i").alias("first"))
    later = Window.partitionBy(key).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(key, "slice", F.last("first", ignorenulls=True).over(later).alias("later"))
    # Backwards in time; an event at the asked moment comes first.
    w = Window.partitionBy(key, "slice").orderBy(F.desc("at"), F.col("src").isNotNull(), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("near", F.last("i", ignorenulls=True).over(w)).where("src IS NOT NULL")
    return out.join(firsts, [key, "slice"]).select(key, "src", F.coalesce("near", "later").alias("i"))


def allowance(events: DataFrame, limit: int, hours: int, now: dt.datetime, seconds: int = 6 * 3600) -> DataFrame:
    """Rolling allowance: the n-th completion of a batch blocks until ``hours`` later, then the next completion starts a new batch.

    Every completion points to the first one that would follow the batch that it starts. Pointers are doubled until they stop
    moving; where the first completion then points is the batch that an organisation is in. A round is one join on (organisation,
    place); rows of one organisation are rows like others, and targets that many rows share are met in SALTS parts.

    ``events`` = (org_id, ts). Events with null time or organisation are ignored; equal times keep one order. Returns org_id, used, blocked, unlock_at.
    """
    e = cut_lineage(numbered(events.select("org_id", "ts").dropna(), "org_id", seconds))
    full = e.select("org_id", (F.col("i") - (limit - 1)).alias("i"), (F.col("ts") + F.expr(f"interval {hours} hours")).alias("unlock_at")).where("i >= 0")
    goes_on = full.where(F.col("unlock_at") <= F.lit(now).cast("timestamp_ntz"))
    to = first_from(e, goes_on.select("org_id", F.col("i").alias("src"), F.col("unlock_at").alias("at")), "org_id", seconds)
    p = cut_lineage(to.where("i IS NOT NULL").select("org_id", F.col("src").alias("i"), F.col("i").alias("to")))
    while True:
        salted = p.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int"))
        target = p.select("org_id", F.col("i").alias("to"), F.col("to").alias("on"), F.explode(F.array(*[F.lit(s) for s in range(SALTS)])).alias("salt"))
        new = cut_lineage(salted.join(target, ["org_id", "to", "salt"], "left").select("org_id", "i", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")))
        p = new.select("org_id", "i", "to")
        if new.where("moved").isEmpty():
            break
    end = e.where("i = 0").select("org_id", "n").join(p.where("i = 0").select("org_id", "to"), "org_id", "left").select("org_id", "n", F.coalesce("to", F.lit(0)).alias("i"))
    j = end.join(full, ["org_id", "i"], "left")
    blocked = F.coalesce(F.col("unlock_at") > F.lit(now).cast("timestamp_ntz"), F.lit(False))
    used = F.when(blocked, limit).when(F.col("unlock_at").isNotNull(), 0).otherwise((F.col("n") - F.col("i")).cast("int"))
    return j.select("org_id", used.cast("int").alias("used"), blocked.alias("blocked"), F.when(blocked, F.col("unlock_at")).cast("timestamp_ntz").alias("unlock_at"))
