"""Sources and streams on several files: folders of parts, one file per trigger, mixed headers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfwright.sources import tables as T
from shelfwright.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(6, "ts").write.parquet(f"{folder}/events.parquet")
    return folder


def test_stream_reads_a_folder_of_parts(spark, parts):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    for folder in (SF, parts):
        assert J.drain(J.event_stream(spark, folder).select("event_id"), "probe").count() == n


def test_each_key_once_over_many_batches(spark, parts):
    def keys(folder, files):
        e = J.event_stream(spark, folder, files_per_trigger=files).where("event_type = 'purchase'")
        return J.first_per_key(e.select(F.expr("org_id % 3").alias("org_id"), F.expr("event_id % 3").alias("k"), "ts"), "org_id", "k")

    many, one = keys(parts, 1), keys(SF, 64)
    assert many.count() == many.distinct().count() == one.count()
    assert sorted(many.collect()) == sorted(one.collect())


def test_files_with_their_own_header_and_separator(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("Store,Category,Sub-Category,Brand,Product,Facings\nS1,c,s,B1,P1,3\n")
    (tmp_path / "b.csv").write_text("Brand;Product;Store;Sub Category;Category;Qty;SKU\nB2;P,2;S2;s;c;4;k\n")
    rows = {r.brand: r for r in T.read_csv(spark, str(tmp_path)).collect()}
    assert (rows["B1"].location, rows["B1"].product_name, rows["B1"].expected_facings, rows["B1"].sku) == ("S1", "P1", "3", None)
    assert (rows["B2"].location, rows["B2"].product_name, rows["B2"].expected_qty, rows["B2"].sku) == ("S2", "P,2", "4", "k")
    assert T.read_planogram_csv(spark, str(tmp_path)).count() == 2
    (tmp_path / "d.csv").write_text('\ufeffstore,brand,category,subcategory,product,qty,Brand\n"S ""3""","B,3",c,s,P3,,other\n\nS4,,c,s\n')
    rows = {r.location: r for r in T.read_csv(spark, str(tmp_path)).collect()}
    assert (rows['S "3"'].brand, rows['S "3"'].expected_qty, rows["S4"].brand, rows["S4"].product_name) == ("B,3", None, None, None) and len(rows) == 4
    assert all(r.source_file.endswith(".csv") for r in rows.values())
    (tmp_path / "c.csv").write_text("Store,Brand\nS3,B3\n")
    with pytest.raises(ValueError, match="category"):
        T.read_planogram_csv(spark, str(tmp_path))


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    base = spark.createDataFrame([(1, "base", -1), (2, "base", -1)], "sku long, kind string, v long")
    source = str(tmp_path / "in.parquet")

    def add(rows):
        spark.createDataFrame(rows, base.schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(source)
        return sorted(map(tuple, J.upsert_stream(stream, base, "sku", "v", "probe", str(tmp_path / "table")).collect()))

    add([(1, "a", 5)])
    add([(1, "old", 3), (3, "c", 4)])
    assert run() == [(1, "a", 5), (2, "base", -1), (3, "c", 4)]
    add([(2, "b", 9)])
    assert run() == [(1, "a", 5), (2, "b", 9), (3, "c", 4)]
    assert run() == [(1, "a", 5), (2, "b", 9), (3, "c", 4)]


def test_once_per_key_holds_one_delay(spark, tmp_path):
    """Keys repeat after the delay: they are still dropped, and the state does not keep them."""
    from datetime import datetime, timedelta

    source, root = str(tmp_path / "in.parquet"), str(tmp_path / "out")
    schema = "org_id long, ts timestamp"
    for k in range(5):
        rows = [(i if i < 20 else 100 * k + i, datetime(2024, 1, 1) + timedelta(hours=k)) for i in range(40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "10 minutes")
    got = sorted(r.org_id for r in J.first_per_key(stream, "org_id", root=root).collect())
    assert got == sorted({i if i < 20 else 100 * k + i for k in range(5) for i in range(40)})
    last = max(int(p.name) for p in (tmp_path / "out" / "state" / "commits").iterdir() if p.name.isdigit())
    state = spark.read.format("statestore").option("batchId", last).load(f"{root}/state").count()
    assert state <= 40


def test_keyed_table_writes_what_changed(spark, tmp_path):
    """A batch of few keys writes few rows; only buckets with many changes are rewritten; a batch given again changes nothing."""
    from shelfwright.sources.keyed_table import KeyedTable

    base = spark.range(2000).selectExpr("id AS sku", "'b' AS kind", "0L AS v")
    table = KeyedTable(spark, str(tmp_path / "t"), "sku", "v", base.schema, buckets=8, most_changes=3)
    table.create(base)
    want = {i: ("b", 0) for i in range(2000)}
    for n in range(5):
        rows = [(7, f"n{n}", n + 1), (7, "older", n), (5000 + n, "new", 1)]
        for sku, kind, v in rows:
            if sku not in want or want[sku][1] <= v:
                want[sku] = (kind, v) if sku != 7 else (f"n{n}", n + 1)
        for _ in range(2):
            table.apply(spark.createDataFrame(rows, base.schema), n)
    assert {r.sku: (r.kind, r.v) for r in table.read().collect()} == want
    written = spark.read.parquet(str(tmp_path / "t" / "changes")).groupBy("batch").count().collect()
    assert all(r["count"] == 2 for r in written)
    rewritten = spark.read.parquet(str(tmp_path / "t" / "base")).where("generation > 0").select("bucket").distinct().count()
    assert 1 <= rewritten < 8
