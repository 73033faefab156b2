"""Tables in the cluster's shared folder, and readers of the input tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.session import ensure_checkpoint_dir

#: White space of every word definition here.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; nothing is created yet."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and executors may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_plans(spark: SparkSession, characters: int = 20_000):
    """Jobs whose plans hold a large literal: its text is not kept with the plan's description in the driver."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, str(characters))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside a lambda."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with those of ``df`` (names are compared without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
