"""Report tables of a scan: KPI export, sectioned report, wide intelligence row and executive summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.operators.shelf_metrics import top_per_scan

SHARES, LEDGER, ADVICE, ALERTS = 15, 15, 10, 20  # fixed values: lines of a report section
PLACEMENT_NOTE = "Facings appear outside the expected category or shelf position"  # fixed value: what a placement alert means


def one(value: Column | str) -> Column:
    """A number with one decimal and no separators; null stays null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.format_string("%.1f", value.cast("double")))


def kpi_export(m: DataFrame, scope: str = "") -> DataFrame:
    """Long KPI rows of a metrics table: scan_id, line_no, kpi, value, numerator, denominator, coverage, state, scope.

    The denominator is a number as text or the basis of a count. A missing value stays null; only the execution score and the
    on-shelf availability say why (``withheld``, ``not_configured``), all others are ``ready``. ``scope`` goes with shares.
    """
    none = F.lit(None)
    col = F.col
    image, human = F.lit("assessed image"), F.lit("human verified")
    total, cov = col("total_facings"), col("recognition_coverage_percent")
    score_state = F.when(col("score_state") != "available", "withheld").when(col("execution_score").isNull(), "not_configured").otherwise("ready")
    plan_state = F.when(col("planogram_percent").isNull(), "not_configured").otherwise("ready")
    rows = [
        ("Shelf execution score", col("execution_score"), none, none, none, score_state),
        ("Visible facings", total, total, image, cov, None),
        ("AI Facings", total, total, image, none, None),
        ("Verified Facings", col("verified_facings"), col("verified_facings"), human, none, None),
        ("AI Visible Units", col("visible_units"), col("visible_units"), image, none, None),
        ("Verified Visible Units", col("verified_visible_units"), col("verified_visible_units"), human, none, None),
        ("Unique SKUs", col("unique_skus"), col("unique_skus"), total, none, None),
        ("Unique brands", col("unique_brands"), col("unique_brands"), total, none, None),
        ("Recognition coverage %", cov, none, none, cov, None),
        ("On-shelf availability %", col("availability_percent"), none, none, none, plan_state),
        ("Facing compliance %", col("facing_compliance_percent"), none, none, none, None),
        ("Placement compliance %", col("placement_compliance_percent"), none, none, none, None),
        ("Planogram compliance %", col("planogram_percent"), none, none, none, None),
        ("Share of shelf %", col("share_of_shelf_percent"), none, none, none, None),
        ("Confirmed shelf absence count", col("verified_shelf_absence_count"), none, none, none, None),
        ("Low stock / suspected gaps", col("low_stock_products"), none, none, none, None),
        ("Placement issues", col("misplaced_facings"), none, none, none, None),
        ("Avg confidence %", col("average_confidence_percent"), none, none, none, None),
    ]

    def row(no: int, name: str, value: Column, num: Column, den: Column, coverage: Column, state: Column | None) -> Column:
        of = F.lit(f"scope={scope}" if scope and "share" in name.lower() else "")
        return F.struct(F.lit(no).alias("line_no"), F.lit(name).alias("kpi"), value.cast("double").alias("value"), num.cast("double").alias("numerator"),
                        den.cast("string").alias("denominator"), coverage.cast("double").alias("coverage"), (F.lit("ready") if state is None else state).alias("state"), of.alias("scope"))

    return m.select("scan_id", F.explode(F.array(*[row(no, *r) for no, r in enumerate(rows, 1)])).alias("r")).select("scan_id", "r.*")


def section(rows: DataFrame, name: str, line_no: Column | str, label: Column | str, value: Column | str, detail: Column | str) -> DataFrame:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select("scan_id", F.lit(name).alias("section"), as_col(line_no).cast("int").alias("line_no"), as_col(label).alias("label"),
                       as_col(value).cast("string").alias("value"), as_col(detail).cast("string").alias("detail"))


def line_alerts(lines: DataFrame, limit: int = ALERTS) -> DataFrame:
    """The first lines of a scan, by position, that are not correct, with a severity, a title and a detail.

    Missing and wrong products are critical where facings are expected; a line without an issue type needs a review.
    """
    issue = F.coalesce("issue_type", F.lit("review"))
    severe = issue.isin("missing", "wrong_product") & (F.coalesce("expected_qty", F.lit(0)) > 0)
    found = lines.where(~issue.isin("correct", "ok")).select(
        "scan_id", "pos", F.when(severe, "critical").otherwise("warning").alias("severity"),
        F.concat_ws(" ", F.concat(issue, F.lit(":")), "expected_brand", "expected_product").alias("title"),
        F.format_string("%d of %d facing(s)", F.coalesce("actual_qty", F.lit(0)).cast("bigint"), F.coalesce("expected_qty", F.lit(0)).cast("bigint")).alias("detail"))
    return top_per_scan(found, limit, F.col("pos"))


def report(kpis: DataFrame, shares: DataFrame, impact: DataFrame, ledger: DataFrame, advice: DataFrame, lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """One table of report lines: scan_id, section, line_no, label, value, detail.

    Sections: 5 KPIs, 5b brand shares, 6 money at risk, 7 findings (ledger, then recommendations), 7b alerts of planogram lines,
    7c operational alerts. A scan without rows for a section has no lines there.
    """
    named = top_per_scan(shares.where(~F.col("is_unclassified")), SHARES, F.desc("quantity"), F.col("brand"))
    money = impact.select("scan_id", F.explode(F.array(*[
        F.struct(F.lit(no).alias("no"), F.lit(name).alias("label"), F.col(col).cast("bigint").alias("value"), F.lit(evidence).alias("evidence"))
        for no, name, col, evidence in [
            (1, "Est. daily lost sales", "daily_inr", "ESTIMATED"), (2, "Est. weekly lost sales", "weekly_inr", "ESTIMATED"),
            (3, "OOS SKU count", "oos_sku_count", "PHOTO-DETECTED + USER-SUPPLIED"), (4, "At-risk SKU count", "at_risk_sku_count", "PHOTO-DETECTED")]])).alias("r")).select("scan_id", "r.*")
    ranked = ledger.where(F.col("place") <= LEDGER)
    behind = top_per_scan(advice, ADVICE, F.col("rule_no"))
    parts = [
        section(kpis, "5", "line_no", "kpi", one("value"), "state"),
        section(named, "5b", "rank", "brand", one("share"), F.lit("")),
        section(money, "6", "no", "label", "value", "evidence"),
        section(ranked, "7", "place", "rule_id", one("score"), F.trim(F.concat_ws(" ", "brand", "product"))),
        section(behind, "7", F.lit(LEDGER) + F.col("rank"), "title", "priority", F.lit("")),
        section(line_alerts(lines), "7b", "rank", "title", "severity", "detail"),
        section(top_per_scan(alerts, ALERTS, F.col("rule_no")), "7c", "rank", "title", "priority", F.lit("")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def intelligence_row(scans: DataFrame, blocks: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One wide row per scan: each block's columns joined on the scan key, and ``<block>_state``: ``available`` where the block has
    a row for the scan with a value in its first column, else ``not_configured``. A block has at most one row per scan.
    Blocks of one table are joined together, once."""
    out = scans.select("scan_id").distinct()
    tables = {id(rows): rows for rows, _ in blocks.values()}
    for key, rows in tables.items():
        out = out.join(rows.select("scan_id", *[c for of, cols in blocks.values() if id(of) == key for c in cols]), "scan_id", "left")
    state = lambda col: F.when(F.col(col).isNull(), "not_configured").otherwise("available")
    return out.select("scan_id", *[c for name, (_, cols) in blocks.items() for c in (*cols, state(cols[0]).alias(f"{name}_state"))])


def executive_summary(m: DataFrame, scope_label: str = "full image") -> DataFrame:
    """Summary of a scan in sentences; one whose metric is missing or zero is left out."""
    col = F.col
    score = F.when(col("execution_score").isNotNull(), F.concat(
        F.format_string("Execution score %d/100 (assessment coverage ", F.bround("execution_score", 0).cast("bigint")), one("assessment_coverage_percent"), F.lit("%).")))
    share = F.when(col("share_of_shelf_percent").isNotNull() & (col("share_denominator") > 0), F.concat(
        F.lit("Primary brand facing share "), one("share_of_shelf_percent"), F.format_string(f"%% ({scope_label}, %d facings in denominator).", col("share_denominator"))))
    sentences = [
        F.format_string("Observed %d visible facings across %d visual product groups and %d identified brands.", col("total_facings"), col("unique_skus"), col("unique_brands")),
        F.concat(F.lit("Recognition coverage among detections is "), one("recognition_coverage_percent"), F.lit("% (not measured accuracy).")), score, share,
        F.when(col("misplaced_facings") > 0, F.format_string(f"%d placement issue(s) were detected — {PLACEMENT_NOTE.lower()}.", col("misplaced_facings"))),
        F.when(col("low_stock_products") > 0, F.format_string("%d SKU(s) are below the facing threshold.", col("low_stock_products"))),
    ]
    return m.select("scan_id", F.concat_ws(" ", *sentences).alias("summary"))
