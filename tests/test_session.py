"""Rows written where lineage is cut: the same rows, in little space."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from shelfwright.session import cut_lineage, ensure_checkpoint_dir


def test_cut_rows_are_the_same_and_small(spark):
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in root.rglob("*") if f.is_file())
    name = F.concat(F.lit("product "), (F.col("id") % 50).cast("string"))
    df = spark.range(20_000).select("id", F.struct(name.alias("p"), F.split(name, " ").alias("tok"), F.lit(None).cast("double").alias("x")).alias("c"))
    before = size()
    cut = cut_lineage(df)
    assert size() - before < 20_000 * 20  # row objects take over 100 bytes each
    assert cut.columns == df.columns and cut.exceptAll(df).isEmpty() and df.exceptAll(cut).isEmpty()


def test_cut_of_no_rows(spark):
    cut = cut_lineage(spark.range(5).where("id > 9").select("id", F.array("id").alias("a")))
    assert cut.isEmpty() and cut.columns == ["id", "a"]
