"""Audit KPIs from unit evidence states: one long frame of units, one aggregation for all KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.numbers import percent_or_none

# The five KPIs shown to each role, in order.
ROLE_KPIS = {
    "supermarket": ["osa", "planogram_compliance", "assortment_compliance", "price_compliance", "promotional_compliance"],
    "darkstore": ["osa", "location_accuracy", "planogram_compliance", "assortment_compliance", "facing_count"],
    "fmcg": ["share_of_shelf", "osa", "facing_count", "planogram_compliance", "promotional_compliance"],
    "distributor": ["osa", "msl_compliance", "planogram_compliance", "price_compliance", "promotional_compliance"],
    "local": ["osa", "assortment_compliance", "facing_count", "price_compliance", "promotional_compliance"],
}

WRONG = ["wrong_product", "wrong_category", "wrong_location"]


def kpi_struct(passing: Column, assessed: Column, eligible: Column) -> Column:
    """Value, coverage and status of a percentage KPI from its three counts."""
    na, none_seen = eligible <= 0, assessed <= 0
    return F.struct(
        F.when(~na & ~none_seen, percent_or_none(passing, assessed)).alias("value"),
        F.when(na, "not_applicable").when(none_seen, "not_assessable")
        .when(assessed >= eligible, "complete").otherwise("partial").alias("status"),
        F.when(na | none_seen, F.lit(0)).otherwise(passing).alias("numerator"),
        F.when(na | none_seen, F.lit(0)).otherwise(assessed).alias("denominator"),
        F.when(~na, percent_or_none(F.when(none_seen, 0).otherwise(assessed), eligible)).alias("coverage_percent"),
        F.when(na, F.lit(0)).otherwise(F.greatest(F.lit(0), eligible - assessed)).alias("excluded_count"),
    )


def kpi_from_units(units: DataFrame) -> DataFrame:
    """``units`` = (scan_id, kpi_id, state): one row per unit, aggregated before the shuffle."""
    agg = units.groupBy("scan_id", "kpi_id").agg(
        F.count_if(F.col("state") == "pass").alias("p"),
        F.count_if(F.col("state") != "not_assessable").alias("a"), F.count("*").alias("e"))
    return agg.select("scan_id", "kpi_id", kpi_struct(F.col("p"), F.col("a"), F.col("e")).alias("k")).select(
        "scan_id", "kpi_id", "k.*")


def pair_key(brand: str = "brand", product: str = "product_name") -> Column:
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return F.concat(low(brand), F.lit("|"), low(product))


def inventory_lookup(inventory: DataFrame) -> DataFrame:
    """Last inventory row per key, with the quantity a lookup would see."""
    qty = F.coalesce(F.nullif("quantity", F.lit(0)), "facings", F.lit(0))
    fac = F.coalesce(F.nullif("facings", F.lit(0)), "quantity", F.lit(0))
    return inventory.groupBy("scan_id", pair_key().alias("key")).agg(
        F.max_by(F.struct(qty.alias("qty"), fac.alias("facings")), "pos").alias("r")).select(
        "scan_id", "key", F.col("r.qty").alias("inv_qty"), F.col("r.facings").alias("inv_facings"))


def with_inventory(listed: DataFrame, inventory: DataFrame) -> DataFrame:
    return listed.withColumn("key", pair_key()).join(inventory_lookup(inventory), ["scan_id", "key"], "left")


def _unit(df: DataFrame, kpi: str, state: Column) -> DataFrame:
    return df.select("scan_id", F.lit(kpi).alias("kpi_id"), state.alias("state"))


def osa_units(listed: DataFrame, inventory: DataFrame, lines: DataFrame) -> DataFrame:
    issue = lines.where(F.coalesce("issue_type", F.lit("")) != "unexpected").select(
        "scan_id", "pos", "issue_type", F.lit(True).alias("has_line"))
    rows = with_inventory(listed, inventory).join(issue, ["scan_id", "pos"], "left")
    found = F.coalesce("inv_qty", F.lit(0)) > 0
    state = (
        F.when(F.col("issue_type") == "missing", "fail")
        .when(F.col("issue_type").isin(WRONG), F.when(found, "pass").otherwise("fail"))
        .when(found, "pass")
        .when(F.col("has_line").isNull() & F.col("inv_qty").isNull(), "not_assessable")
        .otherwise("fail")
    )
    return _unit(rows, "osa", state)


def position_units(lines: DataFrame) -> DataFrame:
    issue = F.col("issue_type")
    state = (
        F.when(F.coalesce(issue, F.lit("")) == "", "not_assessable").when(issue == "correct", "pass")
        .when(issue.isin("missing", *WRONG, "qty_mismatch", "unexpected"), "fail").otherwise("needs_review"))
    return _unit(lines, "planogram_compliance", state)


def presence_units(listed: DataFrame, inventory: DataFrame, kpi: str) -> DataFrame:
    """Assortment and must-stock lists: present when the inventory holds the item."""
    rows = with_inventory(listed, inventory)
    return _unit(rows, kpi, F.when(F.coalesce("inv_qty", F.lit(0)) > 0, "pass").otherwise("fail"))


def price_units(price_lines: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("status") == "compliant", "pass").when(F.col("status").isin("non_compliant", "mismatch"), "fail")
        .otherwise("not_assessable"))
    return _unit(price_lines, "price_compliance", state)


def promotion_units(promotions: DataFrame, results: DataFrame) -> DataFrame:
    """Active promotions left-joined with their results; a promotion without a result is not assessable."""
    res = results.select("scan_id", "promotion_id", F.col("status").alias("result_status"))
    rows = promotions.join(res, ["scan_id", "promotion_id"], "left")
    status = F.coalesce("result_status", "status")
    return _unit(rows, "promotional_compliance",
                 F.when(status.isin("pass", "fail"), status).otherwise("not_assessable"))


def location_units(lines: DataFrame) -> DataFrame:
    issue = F.col("issue_type")
    rows = lines.where(F.coalesce("actual_qty", F.lit(0)) > 0)
    return _unit(rows, "location_accuracy", F.when(issue.isin(WRONG), "fail").when(
        issue.isin("correct", "qty_mismatch"), "pass").otherwise("not_assessable"))


def location_kpi(lines: DataFrame) -> DataFrame:
    """Occupied positions only; every occupied one counts as assessed."""
    u = location_units(lines).groupBy("scan_id", "kpi_id").agg(
        F.count_if(F.col("state") == "pass").alias("p"), F.count("*").alias("e"))
    return u.select("scan_id", "kpi_id", kpi_struct(F.col("p"), F.col("e"), F.col("e")).alias("k")).select(
        "scan_id", "kpi_id", "k.*")


def facing_count(listed: DataFrame, inventory: DataFrame) -> DataFrame:
    """Observed against planned facings with assessed and eligible positions."""
    expected = F.greatest(F.lit(0), F.coalesce("expected_facings", "expected_qty"))
    rows = with_inventory(listed, inventory).where(
        F.coalesce("expected_facings", "expected_qty").isNotNull())
    agg = rows.groupBy("scan_id").agg(
        F.sum(F.coalesce("inv_facings", F.lit(0))).alias("actual"), F.sum(expected).alias("planned"),
        F.count("inv_facings").alias("assessed"), F.count("*").alias("eligible"))
    return agg.select(
        "scan_id", F.lit("facing_count").alias("kpi_id"), F.col("actual").cast("double").alias("value"),
        F.when(F.col("assessed") < F.col("eligible"), "partial").otherwise("complete").alias("status"),
        F.col("actual").alias("numerator"), F.nullif("planned", F.lit(0)).alias("denominator"),
        percent_or_none(F.col("assessed"), F.col("eligible")).alias("coverage_percent"),
        (F.col("eligible") - F.col("assessed")).alias("excluded_count"))


def linear_share(facings: DataFrame, primary_brand: str) -> DataFrame:
    """Share of shelf by summed box width; any measured width counts as calibrated."""
    width = F.greatest(F.lit(0), F.col("x2") - F.col("x1"))
    own = F.lower(F.trim("brand")) == primary_brand.lower()
    agg = facings.groupBy("scan_id").agg(
        F.sum(width).alias("total"), F.sum(F.when(own, width).otherwise(0)).alias("own"))
    ok = F.col("total") > 0
    return agg.select(
        "scan_id", F.lit("share_of_shelf").alias("kpi_id"),
        percent_or_none(F.col("own"), F.col("total")).alias("value"),
        F.when(ok, "complete").otherwise("not_assessable").alias("status"),
        F.col("own").alias("numerator"), F.col("total").alias("denominator"),
        F.when(ok, F.lit(100.0)).alias("coverage_percent"), F.lit(0).alias("excluded_count"))


def role_dashboards(kpis: DataFrame) -> DataFrame:
    """Five KPIs for each of five roles of every scan; a KPI without data is 'not_configured'."""
    per_scan = kpis.select("scan_id", "kpi_id", "value", "status")
    # One map of at most nine KPIs per scan, exploded over the fixed 25 role slots.
    maps = per_scan.groupBy("scan_id").agg(F.map_from_entries(
        F.collect_list(F.struct("kpi_id", F.struct("value", "status")))).alias("m"))
    slots = F.array(*[F.struct(F.lit(r).alias("role_id"), F.lit(i + 1).alias("slot"), F.lit(k).alias("kpi_id"))
                      for r, ks in ROLE_KPIS.items() for i, k in enumerate(ks)])
    out = maps.select("scan_id", "m", F.explode(slots).alias("s"))
    hit = F.try_element_at("m", F.col("s.kpi_id"))
    return out.select("scan_id", "s.role_id", "s.slot", "s.kpi_id", hit["value"].alias("value"),
                      F.coalesce(hit["status"], F.lit("not_configured")).alias("status"))


def readiness(plan: DataFrame, package: DataFrame) -> DataFrame:
    """Which KPIs a planogram can feed; ``package`` = (scan_id, list_name), one row per supplied list."""
    p = plan.groupBy("scan_id").agg(
        F.bool_or(F.col("mrp_inr").isNotNull()).alias("price"),
        F.bool_or(F.trim(F.coalesce("shelf_position", F.lit(""))) != "").alias("slot"),
        F.bool_or(F.coalesce("expected_facings", "expected_qty").isNotNull()).alias("facing"), F.lit(True).alias("items"))
    names = {"assortment": "assortment_skus", "promo": "promotions", "msl": "msl_skus", "brand": "primary_brand"}
    k = package.groupBy("scan_id").agg(*[F.bool_or(F.col("list_name") == v).alias(c) for c, v in names.items()])
    both = p.join(k, "scan_id", "full").na.fill(False)
    ready = {
        "osa": F.col("items"), "planogram_compliance": F.col("items"),
        "assortment_compliance": F.col("assortment") | F.col("items"), "price_compliance": F.col("price"),
        "promotional_compliance": F.col("promo"), "location_accuracy": F.col("slot"),
        "facing_count": F.col("facing"), "share_of_shelf": F.col("brand"), "msl_compliance": F.col("msl"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("kpi_id"), c.alias("ready")) for n, c in ready.items()])
    return both.select("scan_id", F.explode(pairs).alias("r")).select("scan_id", "r.*")
