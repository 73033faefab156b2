"""Keys, report rows, row labels and merged photos on small literal tables."""

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import keys as K
from shelfwright.operators import capture as C
from shelfwright.operators import report as R
from shelfwright.operators import row_labels as RL

VARIANTS = {"Regular, 2 litre": "2l", "N/A": "", "Single-Serve Bottle": "single serve", "6 pack of cans": "6pk cans", "12-pack cans": "12pk cans", "2  Liters bottle": "2l bottle",
            "12l": "12l", "a2 l": "a2 l", "single served btl red": "single serve red", "6 -- pack cans": "6 -- pack cans", "classic": "", "": "", None: "", "diet-coke (x)": "diet-coke (x)"}


def test_variant_merge_key(spark):
    rows = spark.createDataFrame([(v,) for v in VARIANTS], "v string").select("v", K.variant_merge_key(F.col("v")).alias("k")).collect()
    assert {r.v: r.k for r in rows} == VARIANTS


METRICS = """scan_id long, total_facings int, recognition_coverage_percent double, execution_score double, score_state string, assessment_coverage_percent double, planogram_percent double, verified_facings long,
    verified_visible_units long, visible_units long, unique_skus int, unique_brands int, availability_percent double, facing_compliance_percent double, placement_compliance_percent double,
    share_of_shelf_percent double, share_denominator long, verified_shelf_absence_count long, low_stock_products int, misplaced_facings int, average_confidence_percent double"""


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame([
        (1, 1200, 90.0, 81.25, "available", 100.0, 70.0, 3, 9, 1300, 4, 2, 95.0, 88.0, 97.5, 40.0, 50, 2, 12, 1, 93.1),
        (2, 0, 0.0, None, "not_configured", 64.7, None, None, None, 0, 0, 0, 100.0, 100.0, 100.0, None, None, 0, 0, 0, None)], METRICS)


def test_kpi_export(metrics):
    rows = {(r.scan_id, r.kpi): r for r in R.kpi_export(metrics, "full_image").collect()}
    assert len(rows) == 36
    assert rows[1, "Unique SKUs"][3:6] == (4.0, 4.0, "1200")
    assert (rows[1, "Shelf execution score"].state, rows[2, "Shelf execution score"].state, rows[2, "Shelf execution score"].value) == ("ready", "withheld", None)
    assert rows[2, "On-shelf availability %"].state == "not_configured"
    assert (rows[1, "Share of shelf %"].scope, rows[1, "Visible facings"].scope, rows[1, "Visible facings"].coverage) == ("scope=full_image", "", 90.0)
    assert (rows[2, "Verified Facings"].value, rows[2, "Verified Facings"].denominator) == (None, "human verified")
    assert R.kpi_export(metrics.limit(0)).count() == 0


def test_summary_leaves_out_what_is_missing(metrics):
    text = {r.scan_id: r.summary for r in R.executive_summary(metrics).collect()}
    assert text[2] == "Observed 0 visible facings across 0 visual product groups and 0 identified brands. Recognition coverage among detections is 0.0% (not measured accuracy)."
    assert "Execution score 81/100 (assessment coverage 100.0%)." in text[1] and "(full image, 50 facings in denominator)" in text[1] and "12 SKU(s) are below" in text[1]


def test_line_alerts_limit_and_severity(spark):
    lines = spark.createDataFrame([(1, i, "missing" if i % 2 else "correct", "B", "P", 0 if i == 1 else 2, None) for i in range(60)] + [(2, 1, None, "B", None, None, 3)],
                                  "scan_id long, pos long, issue_type string, expected_brand string, expected_product string, expected_qty int, actual_qty int")
    got = R.line_alerts(lines).orderBy("scan_id", "pos").collect()
    assert len(got) == 21 and [r.rank for r in got[:20]] == list(range(1, 21))
    assert [got[0].severity, got[1].severity, got[1].detail] == ["warning", "critical", "0 of 2 facing(s)"]
    assert (got[20].title, got[20].severity, got[20].detail) == ("review: B", "warning", "3 of 0 facing(s)")


def test_intelligence_row_states(spark, metrics):
    scans = spark.createDataFrame([(1,), (1,), (2,), (3,)], "scan_id long")
    rows = {r.scan_id: r for r in R.intelligence_row(scans, {"plan": (metrics, ["planogram_percent"]), "seen": (metrics, ["total_facings", "unique_skus"])}).collect()}
    assert {k: (r.plan_state, r.seen_state) for k, r in rows.items()} == {1: ("available", "available"), 2: ("not_configured", "available"), 3: ("not_configured", "not_configured")}


ROWS = "scan_id long, row_idx int, pos long, vid long, brand string, confidence double, pack_text string"


def test_labels_move_over_hops(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.4359]), (3, [0.62, 0.7846]), (4, [0.0, 1.0])], "id long, vec array<double>")
    rows = spark.createDataFrame([(1, 0, 1, 1, "A", 0.9, ""), (1, 0, 2, 2, None, 0.5, ""), (1, 0, 3, 3, None, 0.5, ""), (1, 1, 4, 2, None, 0.5, ""), (1, 0, 5, None, None, 0.5, None), (1, 0, 6, 4, None, 0.5, "")], ROWS)
    hops = lambda n: {r.pos: (r.brand, r.hop) for r in RL.propagate(rows, vec, 0.88, n).collect()}
    assert hops(1) == {2: ("A", 1)}
    assert hops(None) == {2: ("A", 1), 3: ("A", 2)} == hops(2)
    assert hops(0) == {} and RL.propagate(rows.limit(0), vec).count() == 0


def test_row_consensus_respects_the_text(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.4359])], "id long, vec array<double>")
    rows = spark.createDataFrame([(1, 0, 1, 1, "Acme", 0.99, ""), (1, 0, 2, 2, "Bolt", 0.8, ""), (1, 0, 3, 1, None, 0.1, "new bolt pack"), (1, 0, 4, 1, None, 0.1, None), (1, 0, 5, 1, None, 0.1, "ACME")], ROWS)
    assert {r.pos: (r.brand, r.confidence) for r in RL.row_consensus(rows, vec).collect()} == {4: ("Acme", 0.92), 5: ("Acme", 0.92)}


def test_votes(spark):
    rows = spark.createDataFrame([(1, 0, "tin", None, "red"), (1, 0, None, "bag", "red"), (1, 0, None, None, None), (1, 1, None, "bag", None), (1, 1, None, "tin", None), (2, 0, None, None, "blue")],
                                 "scan_id long, row_idx int, said string, label string, colour string")
    assert [tuple(r) for r in RL.type_vote(rows, F.col("said"), F.col("label")).collect()] == [(1, 0, "tin", 0.6667)]
    assert sorted(tuple(r) for r in RL.colour_vote(rows, F.col("colour")).collect()) == [(1, 0, "red", 0.6667), (2, 0, "blue", 1.0)]


def test_merged_photos(spark):
    labels = spark.createDataFrame([(1, 2, "a-1 "), (1, 1, "A-1"), (1, 1, ""), (1, 2, None)], "scan_id long, photo int, label string")
    products = spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "scan_id long, photo int, entry string")
    got = sorted((r.list, r.photo, r.entry or "") for r in C.merged_lists(products, labels).collect())
    assert got == [("location_labels", 1, ""), ("location_labels", 1, "A-1"), ("location_labels", 2, ""), ("products", 1, "x"), ("products", 2, "x")]
    photos = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "scan_id long, photo int")
    rows = spark.createDataFrame([(1, 1, "B", "p", "", "c", 3), (1, 3, "b ", "P", None, "C", -4), (1, 3, None, None, None, None, None)],
                                 "scan_id long, photo int, brand string, product_name string, variant string, category string, actual_facings int")
    got = {r.scan_id: tuple(r)[1:] for r in C.merged_summary(photos, rows).collect()}
    assert got == {1: (3, "3,0,0", 3, 1, 1, 1), 2: (1, "0", 0, 0, 0, 0)}
