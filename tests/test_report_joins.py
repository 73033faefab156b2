"""Blocks of one table are joined once; named actions keep brand and product of their own line, also where positions repeat."""

from shelfwright.operators import compare as CP
from shelfwright.operators import report as R


def test_one_join_per_table(spark):
    m = spark.createDataFrame([(1, 5, None), (2, 6, 7)], "scan_id long, a int, b int")
    scans = spark.createDataFrame([(1,), (2,), (3,)], "scan_id long")
    out = R.intelligence_row(scans, {"x": (m, ["a"]), "y": (m, ["b"])})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    assert out.columns == ["scan_id", "a", "x_state", "b", "y_state"]
    assert sorted(map(tuple, out.collect())) == [(1, 5, "available", None, "not_configured"), (2, 6, "available", 7, "available"), (3, None, "not_configured", None, "not_configured")]


def test_named_actions(spark):
    m = spark.createDataFrame([(1, 0, 0, 0)], "scan_id long, verified_shelf_absence_count long, low_stock_products long, misplaced_facings long")
    lines = spark.createDataFrame([(1, 4, "missing", "b", "p"), (1, 4, "missing", "b", "p")], "scan_id long, pos long, issue_type string, expected_brand string, expected_product string")
    got = CP.next_actions(m, lines, named=True).select("rank", "brand", "product").collect()
    assert sorted(map(tuple, got)) == [(1, "b", "p"), (2, "b", "p")]
    assert "brand" not in CP.next_actions(m, lines).columns
