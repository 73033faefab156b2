"""Golden numbers on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright.functions import keys as K
from shelfwright.functions import location as L
from shelfwright.functions import numbers as N
from shelfwright.operators import capture as C
from shelfwright.operators import kpi as Q
from shelfwright.operators import lifecycle as LC
from shelfwright.operators import money as MO
from shelfwright.operators import planogram_match as PM
from shelfwright.operators import shelf_metrics as M
from shelfwright.sources import documents as DO
from shelfwright.sources import tables as T


def kpi(spark, p, a, e):
    return spark.range(1).select(Q.kpi_struct(F.lit(p), F.lit(a), F.lit(e)).alias("k")).select("k.*").first()


def test_kpi_ladder(spark):
    r = kpi(spark, 18, 20, 25)
    assert (r.value, r.coverage_percent, r.excluded_count, r.status) == (90.0, 80.0, 5, "partial")
    assert kpi(spark, 42, 50, 50).value == 84.0 and kpi(spark, 42, 50, 50).status == "complete"
    assert kpi(spark, 27, 30, 30).value == 90.0 and kpi(spark, 19, 20, 20).value == 95.0
    assert kpi(spark, 0, 0, 0).status == "not_applicable"
    empty = kpi(spark, 0, 0, 7)
    assert (empty.status, empty.value, empty.excluded_count) == ("not_assessable", None, 7)


NINE = [("Colgate", 42, "ok"), ("Pepsodent", 20, "ok"), ("Closeup", 12, "ok"), ("Sensodyne", 10, "ok"), ("Dabur", 8, "ok"), ("Patanjali", 7, "ok"),
        ("Himalaya", 5, "ok"), ("Dove", 6, "category_mismatch"), ("Unknown", 6, "category_mismatch")]


def inventory(spark):
    return spark.createDataFrame([(1, i, b, q, q, s, True) for i, (b, q, s) in enumerate(NINE)],
                                 "scan_id int, pos int, brand string, quantity int, facings int, compliance_status string, counted_in_totals boolean")


def test_brand_share_scopes(spark):
    inv = inventory(spark)
    audited = {r.brand: r.share for r in M.brand_share(inv, exclude_mismatch=True).collect()}
    full = {r.brand: r.share for r in M.brand_share(inv).collect()}
    assert audited["Colgate"] == 40.4 and full["Colgate"] == 36.2
    pay = {r.scope: r for r in M.brand_share_payload(inv, True).unionByName(M.brand_share_payload(inv, False)).collect()}
    assert pay["eligible_category"].denominator == 104 and pay["full_image"].denominator == 116
    assert pay["full_image"].identified_brands == 8 and pay["eligible_category"].identified_brands == 7
    assert pay["eligible_category"].unclassified_facings == 0


def test_recognition_coverage(spark):
    fac = spark.range(116).select(F.lit(1).alias("scan_id"), F.when(F.col("id") < 6, "Unknown").otherwise("A").alias("brand"),
                                  F.lit("p").alias("product_name"), F.lit(False).alias("exclude_from_inventory"))
    assert M.scan_metrics(inventory(spark), fac).first().recognition_coverage_percent == 94.8


def test_score_withheld(spark):
    m = spark.createDataFrame([(1, 0.0, 0.0, None, None, True, True)],
                              "scan_id int, availability_percent double, planogram_percent double, facing_compliance_percent double, "
                              "placement_compliance_percent double, planogram_configured boolean, has_facings boolean")
    r = M.execution_score(m).first()
    assert r.execution_score is None and r.score_state == "not_configured"


def test_expiry_reconciliation(spark):
    attempts = spark.createDataFrame([(1, 4), (2, 5)], "attempt_id int, physical_count int")
    counts = spark.createDataFrame([(1, 2, 1, 1, 0, 4), (2, 2, 1, 1, 0, 4)], "attempt_id int, sellable int, remove int, unresolved int, expired int, observations int")
    got = {r.attempt_id: r.reconciled for r in LC.reconciliation(attempts, counts).collect()}
    assert got == {1: True, 2: False}


def test_substitution_scenario(spark):
    dem = spark.createDataFrame([(1, "a", 5.0, 100.0, 20.0)], "scan_id int, item string, units double, price double, contribution double")
    sub = spark.createDataFrame([(1, "a", 2.5, 100.0, 20.0)], dem.schema)
    r = MO.substitution_adjusted(dem, sub).first()
    assert (r.gross_exposure, r.net_revenue, r.net_contribution) == (500.0, 250.0, 50.0)


def test_units_capped_to_facings(spark):
    p = spark.createDataFrame([(1, 5, 9), (1, None, 3), (1, 4, 2)], "scan_id int, actual_facings int, actual_visible_units int")
    assert [(r.actual_visible_units, r.capped) for r in C.cap_units(p).collect()] == [(5, True), (3, False), (2, False)]


def test_partial_label_is_no_location(spark):
    df = spark.createDataFrame([("AMB-D07??", "AMB-D0712"), ("A-1", "A-2"), ("", "A-1")], "a string, b string")
    assert [r.f for r in df.select(L.fits(L.normalize_label(F.col("a")), L.normalize_label(F.col("b"))).alias("f")).collect()] == [True, False, False]


def test_keys(spark):
    df = spark.createDataFrame([("Lay's", "chips"), ("HEAD", "Shoulder care"), ("louis", "x")], "b string, p string")
    assert [r.k for r in df.select(K.brand_key(F.col("b"), F.col("p")).alias("k")).collect()] == ["lays", "head & shoulders", "lays"]


def test_zero_denominator_is_null(spark):
    assert spark.range(1).select(N.percentage(F.lit(3), F.lit(0)).alias("x")).first().x is None


def test_best_pair_wins_whatever_the_order(spark):
    cols = "scan_id bigint, pos bigint, brand string, product_name string, variant string, sku string, sub_category string, location string"
    cv_cols = ("scan_id bigint, pos bigint, brand string, product_name string, variant string, sku string, category string, sub_category string, "
               "brand_status string, product_status string, variant_status string, location_label string")
    plan = [(1, 0, "Lay's", "Potato Chips", "Classic Salted", "", "", ""), (1, 1, "Lay's", "Potato Chips", "Spanish Tomato Tango", "", "", "")]
    cv = [(1, 7, "Lays", "Potato Chips", "Tangy Tomato", "", "", "", "IDENTIFIED", "IDENTIFIED", "IDENTIFIED", None)]
    for flip in (1, -1):
        p = [(s, i if flip > 0 else 1 - i, *rest) for s, i, *rest in plan]
        rows = PM.join_planogram(spark.createDataFrame(cv, cv_cols), spark.createDataFrame(p, cols)).where("j = 7").collect()
        assert len(rows) == 1 and rows[0].match_status == "MATCHED"
        assert [r[4] for r in p if r[1] == rows[0].i] == ["Spanish Tomato Tango"]


def test_header_reused_on_continuation_page(spark):
    cells = spark.createDataFrame([(1, 1, 0, ["Item", "Qty"]), (1, 1, 1, ["soap", "3"]), (1, 2, 0, ["oil", "4"])], "doc_id int, page int, row int, cells array<string>")
    got = sorted((r.page, r.header[0], r.cells[0]) for r in DO.normalize_tables(cells).collect())
    assert got == [(1, "Item", "soap"), (2, "Item", "oil")]


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿Store;Brand;Product\nA;B;C\n")
    try:
        T.read_planogram_csv(spark, str(tmp_path / "p.csv"))
    except ValueError as exc:
        assert "category" in str(exc) and "expected_facings" in str(exc)
    else:
        raise AssertionError("a file without required columns was accepted")


def test_price_exceptions_are_the_first_twenty_lines(spark):
    from shelfwright.operators import money as MO

    status = lambda i: ("compliant", "non_compliant", "not_observable")[i % 3]
    lines = spark.createDataFrame([(s, i, "Brand", "p" * 40 if i == 1 else None, 10.0, 11.0, 1.0, status(i)) for s, n in ((1, 25), (2, 3)) for i in range(n)],
                                  "scan_id int, pos int, brand string, product_name string, expected_price_inr double, detected_price_inr double, variance_inr double, status string")
    got = sorted((r.scan_id, r.line_no, r.product, r.status) for r in MO.price_exceptions(lines).collect())
    assert got == [(s, i + 1, "Brand " + "p" * 26 if i == 1 else "Brand", status(i)) for s, n in ((1, 20), (2, 3)) for i in range(n)]
