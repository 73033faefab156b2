"""Queries: KPI export, sectioned report, intelligence row, summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright.operators import compare as CP
from shelfwright.operators import money as MO
from shelfwright.operators import report as R
from shelfwright.operators import shelf_metrics as M
from shelfwright.plans import execution as X
from shelfwright.plans.registry import query
from shelfwright.session import cut_lineage

c = F.col
SCORE = """SELECT scan_id, CASE WHEN used / planned >= 0.8e0 THEN round_even(score, 1) END AS execution_score, CASE WHEN used / planned >= 0.8e0 THEN 'available' ELSE 'not_configured' END AS score_state,
    round_even(used / planned * 100.0e0, 1) AS assessment_coverage_percent FROM (SELECT *, CASE WHEN conf THEN 85.0e0 ELSE 100.0e0 END AS planned,
      0.0e0 + availability_percent * wa / used + CASE WHEN conf THEN planogram_percent * 20.0e0 / used ELSE 0.0e0 END + CASE WHEN has THEN facing_compliance_percent * wf / used ELSE 0.0e0 END
      + CASE WHEN has THEN placement_compliance_percent * wp / used ELSE 0.0e0 END AS score
      FROM (SELECT *, wa + CASE WHEN conf THEN 20.0e0 ELSE 0.0e0 END + CASE WHEN has THEN wf + wp ELSE 0.0e0 END AS used
        FROM (SELECT *, planogram_percent IS NOT NULL AS conf, total_facings > 0 AS has, CASE WHEN planogram_percent IS NOT NULL THEN 25.0e0 ELSE 35.0e0 END AS wa,
          CASE WHEN planogram_percent IS NOT NULL THEN 15.0e0 ELSE 35.0e0 END AS wf, CASE WHEN planogram_percent IS NOT NULL THEN 15.0e0 ELSE 30.0e0 END AS wp FROM met)))"""
REP = {
    **X.LED,
    "met": "/*stored*/ " + X.LED["met"], "nba12": "/*stored*/ " + X.LED["nba12"], "led": "/*stored*/ " + X.LED["led"], "imp": "/*stored*/ " + X.LED["imp"],
    "scored": SCORE,
    "own": "SELECT scan_id, max(CASE WHEN brand = 'Brand#1' THEN share END) AS share_of_shelf_percent, sum(quantity) AS share_denominator FROM share_all GROUP BY scan_id",
    "human": "SELECT assignment_id AS scan_id, nullif(count(actual_qty), 0) AS verified_facings, sum(actual_qty) AS verified_visible_units FROM audit GROUP BY assignment_id",
    "conf": "SELECT scan_id, round_even(CAST(sum(CAST(confidence AS DECIMAL(20,8))) AS DOUBLE) / count(*) * 100.0e0, 1) AS average_confidence_percent FROM fac GROUP BY scan_id",
    "rmet": """/*stored*/ SELECT m.*, m.total_products AS visible_units, s.* EXCLUDE (scan_id), o.* EXCLUDE (scan_id), h.* EXCLUDE (scan_id), f.* EXCLUDE (scan_id) FROM met m
        JOIN scored s ON m.scan_id = s.scan_id LEFT JOIN own o ON m.scan_id = o.scan_id LEFT JOIN human h ON m.scan_id = h.scan_id LEFT JOIN conf f ON m.scan_id = f.scan_id""",
}
#: name, value, numerator, denominator, coverage, state
KPIS = [
    ("Shelf execution score", "execution_score", "", "", "", "CASE WHEN score_state <> 'available' THEN 'withheld' WHEN execution_score IS NULL THEN 'not_configured' ELSE 'ready' END"),
    ("Visible facings", "total_facings", "total_facings", "'assessed image'", "recognition_coverage_percent", ""), ("AI Facings", "total_facings", "total_facings", "'assessed image'", "", ""),
    ("Verified Facings", "verified_facings", "verified_facings", "'human verified'", "", ""), ("AI Visible Units", "visible_units", "visible_units", "'assessed image'", "", ""),
    ("Verified Visible Units", "verified_visible_units", "verified_visible_units", "'human verified'", "", ""), ("Unique SKUs", "unique_skus", "unique_skus", "total_facings", "", ""),
    ("Unique brands", "unique_brands", "unique_brands", "total_facings", "", ""), ("Recognition coverage %", "recognition_coverage_percent", "", "", "recognition_coverage_percent", ""),
    ("On-shelf availability %", "availability_percent", "", "", "", "CASE WHEN planogram_percent IS NULL THEN 'not_configured' ELSE 'ready' END"),
    ("Facing compliance %", "facing_compliance_percent", "", "", "", ""), ("Placement compliance %", "placement_compliance_percent", "", "", "", ""),
    ("Planogram compliance %", "planogram_percent", "", "", "", ""), ("Share of shelf %", "share_of_shelf_percent", "", "", "", ""),
    ("Confirmed shelf absence count", "verified_shelf_absence_count", "", "", "", ""), ("Low stock / suspected gaps", "low_stock_products", "", "", "", ""),
    ("Placement issues", "misplaced_facings", "", "", "", ""), ("Avg confidence %", "average_confidence_percent", "", "", "", ""),
]
REP["kpi"] = "/*stored*/ " + " UNION ALL ".join(
    f"""SELECT scan_id, {no} AS line_no, '{name}' AS kpi, CAST({v} AS DOUBLE) AS value, CAST({num or 'NULL'} AS DOUBLE) AS numerator, CAST({den or 'NULL'} AS VARCHAR) AS denominator,
    CAST({cov or 'NULL'} AS DOUBLE) AS coverage, {state or "'ready'"} AS state, '{'scope=full_image' if 'share' in name.lower() else ''}' AS scope FROM rmet"""
    for no, (name, v, num, den, cov, state) in enumerate(KPIS, 1))
REP["advice"] = """SELECT scan_id, 1 AS rule_no, 'high' AS priority, 'Review ' || verified_shelf_absence_count || ' verified shelf absence(s)' AS title FROM rmet WHERE verified_shelf_absence_count > 0
    UNION ALL SELECT scan_id, 2, 'high', 'Replenish ' || low_stock_products || ' low-stock SKUs' FROM rmet WHERE low_stock_products > 0
    UNION ALL SELECT scan_id, 3, 'high', 'Fix ' || misplaced_facings || ' misplaced facings' FROM rmet WHERE misplaced_facings > 0 UNION ALL SELECT scan_id, 4, 'medium', 'Restore planogram compliance' FROM rmet WHERE planogram_percent < 85"""
REP["warned"] = """SELECT scan_id, 1 AS rule_no, 'high' AS priority, verified_shelf_absence_count || ' verified shelf absence(s)' AS title FROM rmet WHERE verified_shelf_absence_count > 0
    UNION ALL SELECT scan_id, 2, CASE WHEN low_stock_products > 10 THEN 'high' ELSE 'medium' END, low_stock_products || ' SKUs below facing threshold' FROM rmet WHERE low_stock_products > 0
    UNION ALL SELECT scan_id, 3, 'high', misplaced_facings || ' placement issues detected' FROM rmet WHERE misplaced_facings > 0"""
REP["ledger"] = """/*stored*/ SELECT scan_id, brand, product, root, rule_id, score, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, rank) AS place FROM (SELECT scan_id, lower(coalesce(brand, '')) AS brand, lower(coalesce(product, '')) AS product, root, rule_id, score, rank,
    row_number() OVER (PARTITION BY scan_id, lower(coalesce(brand, '')), lower(coalesce(product, '')), root ORDER BY score DESC, rank) AS rn FROM led) WHERE rn = 1 QUALIFY place <= 25"""


def metrics(d):
    """Everything that report lines say about a scan, in one row; written once, as several tables are made of it."""
    m = X._metrics(d)
    score = M.execution_score(m.withColumn("planogram_configured", c("planogram_percent").isNotNull()).withColumn("has_facings", c("total_facings") > 0))
    own = M.brand_share(d.inv).groupBy("scan_id").agg(F.max(F.when(c("brand") == "Brand#1", c("share"))).alias("share_of_shelf_percent"), F.sum("quantity").alias("share_denominator"))
    human = d.audit.groupBy(c("assignment_id").alias("scan_id")).agg(F.nullif(F.count("actual_qty"), F.lit(0)).alias("verified_facings"), F.sum("actual_qty").alias("verified_visible_units"))
    conf = d.fac.groupBy("scan_id").agg(F.bround(F.sum(c("confidence").cast("decimal(20,8)")).cast("double") / F.count("*") * 100.0, 1).alias("average_confidence_percent"))
    out = m.withColumn("visible_units", c("total_products")).join(score, "scan_id")
    for block in (own, human, conf):
        out = out.join(block, "scan_id", "left")
    return cut_lineage(out)


def findings(d, m):
    """First actions, money at risk and the ledger of all scans; ``d`` has written tables."""
    actions = cut_lineage(CP.next_actions(m, d.lines, named=True))
    impact = cut_lineage(MO.impact_from_lines(d.lines, d.plan))
    return actions, impact, CP.opportunity_ledger(actions, impact)


@query("a11_kpi_export", "SELECT * FROM kpi", REP)
def a11(d):
    return R.kpi_export(metrics(d), "full_image")


@query("a12_sectioned_report", """SELECT scan_id, '5' AS section, line_no, kpi AS label, format('{:.1f}', value) AS value, state AS detail FROM kpi
    UNION ALL SELECT scan_id, '5b', rank, brand, format('{:.1f}', share), '' FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY quantity DESC, brand) AS rank FROM share_all WHERE NOT is_unclassified) WHERE rank <= 15
    UNION ALL SELECT scan_id, '6', no, label, CAST(value AS VARCHAR), evidence FROM (SELECT scan_id, unnest([1, 2, 3, 4]) AS no, unnest(['Est. daily lost sales', 'Est. weekly lost sales', 'OOS SKU count', 'At-risk SKU count']) AS label,
        unnest([CAST(daily_inr AS BIGINT), CAST(weekly_inr AS BIGINT), oos_sku_count, at_risk_sku_count]) AS value, unnest(['ESTIMATED', 'ESTIMATED', 'PHOTO-DETECTED + USER-SUPPLIED', 'PHOTO-DETECTED']) AS evidence FROM imp)
    UNION ALL SELECT scan_id, '7', place, rule_id, format('{:.1f}', score), trim(brand || ' ' || product) FROM ledger WHERE place <= 15
    UNION ALL SELECT scan_id, '7', 15 + row_number() OVER (PARTITION BY scan_id ORDER BY rule_no), title, priority, '' FROM advice
    UNION ALL SELECT scan_id, '7b', rank, title, severity, detail FROM (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY pos) AS rank, coalesce(issue_type, 'review') || ': ' || expected_brand || ' ' || expected_product AS title,
        CASE WHEN issue_type IN ('missing', 'wrong_product') AND coalesce(expected_qty, 0) > 0 THEN 'critical' ELSE 'warning' END AS severity, coalesce(actual_qty, 0) || ' of ' || coalesce(expected_qty, 0) || ' facing(s)' AS detail FROM lines WHERE coalesce(issue_type, 'review') <> 'correct') WHERE rank <= 20
    UNION ALL SELECT scan_id, '7c', row_number() OVER (PARTITION BY scan_id ORDER BY rule_no), title, priority, '' FROM warned""", REP)
def a12(d):
    d = d.written()
    m = metrics(d)
    _, impact, ledger = findings(d, m)
    return R.report(R.kpi_export(m, "full_image"), M.brand_share(d.inv), impact, ledger, CP.recommendations(m), d.lines, CP.alerts(m))


MET_COLS = {"recognition_coverage": ["recognition_coverage_percent"], "ai_confidence": ["average_confidence_percent"], "placement": ["placement_compliance_percent"], "planogram": ["planogram_percent"],
            "share_of_facings": ["share_of_shelf_percent"], "execution": ["execution_score", "assessment_coverage_percent"]}
G66_BLOCKS = {
    **{name: ("rmet", cols) for name, cols in MET_COLS.items()},
    "image": ("img", ["quality_score", "rescan_recommended"]),
    "assortment": ("""(SELECT e.scan_id, round_even(coalesce(found, 0) / expected * 100.0e0, 1) AS breadth_percent, greatest(0, expected - coalesce(found, 0)) AS missing FROM (SELECT scan_id, count(*) AS expected FROM plan GROUP BY scan_id) e
        LEFT JOIN (SELECT scan_id, count(*) FILTER (issue_type IN ('correct', 'qty_mismatch')) AS found FROM lines GROUP BY scan_id) f ON e.scan_id = f.scan_id)""", ["breadth_percent", "missing"]),
    "availability": ("""(SELECT *, round_even(greatest(0.0e0, 100.0e0 - oos_rate - low_stock_rate * 0.5e0), 1) AS basic_osa FROM (SELECT e.scan_id, round_even(coalesce(v.verified_shelf_absence_count, 0) / expected * 100.0e0, 1) AS oos_rate,
        round_even(coalesce(v.low_stock_products, 0) / expected * 100.0e0, 1) AS low_stock_rate FROM (SELECT scan_id, count(*) AS expected FROM plan GROUP BY scan_id) e LEFT JOIN rmet v ON e.scan_id = v.scan_id))""", ["basic_osa", "oos_rate", "low_stock_rate"]),
    "facings": (f"({X.FUL})", ["fulfilment_percent", "facing_gap"]),
    "impact": ("imp", ["daily_inr", "weekly_inr", "oos_sku_count", "at_risk_sku_count"]),
    "ledger": ("(SELECT scan_id, count(*) AS opportunities, max(score) AS top_score, arg_min(rule_id, place) AS top_rule FROM ledger GROUP BY scan_id)", ["opportunities", "top_score", "top_rule"]),
    "actions": ("(SELECT scan_id, count(*) AS actions, string_agg(rule_id, ',' ORDER BY rank) AS action_rules FROM nba12 GROUP BY scan_id)", ["actions", "action_rules"]),
}
REP["img"] = """SELECT scan_id, CASE WHEN seen THEN greatest(0.0e0, least(100.0e0, round_even(det - e * 2 - w * 1.5e0, 0))) ELSE least(det, 85.0e0) END AS quality_score, (seen AND w / t > 0.35e0) OR (seen AND e / t > 0.25e0) OR cov < 50 AS rescan_recommended FROM (
    SELECT *, greatest(0.0e0, least(100.0e0, round_even(100.0e0 - greatest(0.0e0, 50.0e0 - cov), 0))) AS det FROM (
    SELECT q.scan_id, e, w, (av > 0 OR e + w > 0) AS seen, greatest(c.total_facings, 1) AS t, c.recognition_coverage_percent AS cov FROM (SELECT scan_id, count(*) FILTER (length(trim(pack_text)) < 3) AS e, count(*) FILTER (length(trim(pack_text)) >= 3 AND ocr_confidence < 0.55e0) AS w,
      max(ocr_confidence) AS av FROM fac GROUP BY scan_id) q JOIN rmet c ON q.scan_id = c.scan_id))"""


@query("g66_intelligence_row", "SELECT s.scan_id, " + ", ".join(
    ", ".join(f"{name}.{col}" for col in cols) + f", CASE WHEN {name}.{cols[0]} IS NULL THEN 'not_configured' ELSE 'available' END AS {name}_state" for name, (_, cols) in G66_BLOCKS.items())
    + " FROM (SELECT DISTINCT scan_id FROM plan) s " + " ".join(f"LEFT JOIN {rows} {name} ON s.scan_id = {name}.scan_id" for name, (rows, _) in G66_BLOCKS.items()), REP)
def g66(d):
    """One wide row per planned scan: thirteen blocks with their states."""
    d = d.written()
    m = metrics(d)
    actions, impact, ledger = findings(d, m)
    quality = M.facing_quality(d.fac).join(m.select("scan_id", "total_facings", "recognition_coverage_percent"), "scan_id")
    rows = {
        **{name: m for name in MET_COLS}, "image": CP.image_quality(quality), "assortment": CP.assortment_breadth(d.plan, d.lines),
        "availability": CP.availability_block(d.plan, m.withColumn("confirmed_oos_count", c("verified_shelf_absence_count"))), "facings": CP.facing_fulfilment(d.lines), "impact": impact,
        "ledger": ledger.groupBy("scan_id").agg(F.count("*").alias("opportunities"), F.max("score").alias("top_score"), F.min_by("rule_id", "place").alias("top_rule")),
        "actions": actions.groupBy("scan_id").agg(F.count("*").alias("actions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule_id"))), lambda x: x["rule_id"]), ",").alias("action_rules")),
    }
    return R.intelligence_row(d.plan, {name: (rows[name], cols) for name, (_, cols) in G66_BLOCKS.items()})


@query("f23_summary_text", f"""SELECT scan_id, concat_ws(' ', 'Observed ' || total_facings || ' visible facings across ' || unique_skus || ' visual product groups and ' || unique_brands || ' identified brands.',
    'Recognition coverage among detections is ' || format('{{:.1f}}', recognition_coverage_percent) || '% (not measured accuracy).',
    'Execution score ' || CAST(CAST(round_even(execution_score, 0) AS BIGINT) AS VARCHAR) || '/100 (assessment coverage ' || format('{{:.1f}}', assessment_coverage_percent) || '%).',
    CASE WHEN share_denominator > 0 THEN 'Primary brand facing share ' || format('{{:.1f}}', share_of_shelf_percent) || '% (full image, ' || share_denominator || ' facings in denominator).' END,
    CASE WHEN misplaced_facings > 0 THEN misplaced_facings || ' placement issue(s) were detected — {R.PLACEMENT_NOTE.lower()}.' END,
    CASE WHEN low_stock_products > 0 THEN low_stock_products || ' SKU(s) are below the facing threshold.' END) AS summary FROM rmet""", REP)
def f23(d):
    return R.executive_summary(metrics(d))
