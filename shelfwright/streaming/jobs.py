"""Structured Streaming jobs over the audit event log, and a helper that drains a source to a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.session import ensure_checkpoint_dir
from shelfwright.sources.keyed_table import KeyedTable, KeyLedger
from shelfwright.streaming.ordered import STORE


def event_stream(spark: SparkSession, folder: str, name: str = "events", delay: str = "10 minutes", files_per_trigger: int = 64) -> DataFrame:
    """Append-only event source with a watermark on ``ts``; the table is a file or a folder of part files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # As a pattern, since a stream takes a plain path for a folder.
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "org_id").withWatermark("ts", delay)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over everything available into a Parquet table and read it back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,2)")).alias("v")).select(
        F.col("w.start").alias("start"), "event_type", "n", F.col("v").cast("double").alias("total"))


def busy_windows(events: DataFrame, width: str, slide: str, limit: int) -> DataFrame:
    """Keys over a limit in any sliding window: the cheap form of the rate rule."""
    return events.groupBy(F.window("ts", width, slide).alias("w"), "org_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(
        F.col("w.start").alias("start"), "org_id", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("s"), "org_id").agg(F.count("*").alias("n")).select(
        "org_id", F.col("s.start").alias("start"), "n")


def first_per_key(events: DataFrame, *keys: str, name: str = "once", root: str | None = None) -> DataFrame:
    """Each key once, whenever its rows arrive, as a table.

    The stream's state holds the keys of one watermark delay; what repeats later meets the ledger of all keys, which is stored. A
    batch that fails is done again with the same result, and a restart with the same ``root`` goes on from there. Rows behind the watermark
    are dropped by the stream, as in every other job over it.
    """
    spark = events.sparkSession
    spark.conf.set(*STORE)
    root = root or f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    ledger = KeyLedger(spark, f"{root}/keys", T.StructType([events.schema[k] for k in keys]))
    once = events.dropDuplicatesWithinWatermark(list(keys)).select(*keys)
    q = (once.writeStream.foreachBatch(lambda batch, number: ledger.add(batch, number)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return ledger.read()


def enrich(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream-static join; Spark broadcasts the dimension only when it is small enough."""
    return events.join(dimension, key)


def within_window(left: DataFrame, right: DataFrame, key: str, minutes: int) -> DataFrame:
    """Left events with a right event of the same key up to ``minutes`` later, or none."""
    a = left.select(F.col(key).alias("k"), F.col("event_id").alias("left_id"), F.col("ts").alias("lts"))
    b = right.select(F.col(key).alias("rk"), F.col("event_id").alias("right_id"), F.col("ts").alias("rts"))
    cond = (F.col("k") == F.col("rk")) & (F.col("rts") >= F.col("lts")) & (F.col("rts") <= F.col("lts") + F.expr(f"interval {minutes} minutes"))
    return a.join(b, cond, "left_outer").select("k", "left_id", "right_id")


def upsert_stream(events: DataFrame, base: DataFrame, key: str, version: str, name: str, root: str | None = None, buckets: int = 64) -> DataFrame:
    """Every micro-batch appends its newest row per key to a keyed table, which compacts buckets as they fill.

    A repeated or restarted batch gives the same table; a restart with the same ``root`` goes on from there and does not look at ``base``.
    """
    spark = events.sparkSession
    root = root or f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{root}/table", key, version, base.schema, buckets)
    table.create(base)
    q = events.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read()


def late_rows(events: DataFrame, minutes: int, width: int = 1024) -> DataFrame:
    """Rows behind the watermark in arrival order, counted per event type.

    The running maximum is taken inside ranges of arrival ids and carried over from the maxima of the
    earlier ranges, so no single task sees all events.
    """
    from pyspark.sql import Window

    e = events.withColumn("slot", F.floor(F.col("event_id") / width))
    top = e.groupBy("slot").agg(F.max("ts").alias("m"))
    carry = top.select("slot", F.max("m").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy("slot").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("ts").over(w), F.col("before"))
    late = e.join(carry, "slot").withColumn("seen", seen).where(F.col("ts") < F.col("seen") - F.expr(f"interval {minutes} minutes"))
    return late.groupBy("event_type").agg(F.count("*").alias("late"))
