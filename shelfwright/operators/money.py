"""Price checks, stock-out evidence, money at risk and value definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions.location import price_in_text
from shelfwright.operators.kpi import pair_key

# Indicative price, velocity and low-stock factor where nothing is configured.
DEFAULT_PRICE, UNITS_PER_DAY, LOW_STOCK_FACTOR, LOW_STOCK = 75.0, 4.0, 0.35, 2
ABSENT = ["missing", "wrong_product", "wrong_category", "wrong_location"]


def price_lines(classified: DataFrame, plan: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Detected against planned price per facing; of duplicate plan rows the last one counts."""
    wanted = plan.groupBy("scan_id", pair_key().alias("key")).agg(
        F.max_by(F.struct(F.col("mrp_inr").alias("p")), "pos").alias("m")).select(
        "scan_id", "key", F.col("m.p").alias("expected_price_inr")).where("expected_price_inr IS NOT NULL")
    rows = classified.withColumn("key", pair_key()).join(wanted, ["scan_id", "key"])
    det = price_in_text(F.col("pack_text"))
    var = F.bround(det - F.col("expected_price_inr"), 2)
    return rows.select(
        "scan_id", "pos", "brand", "product_name", "expected_price_inr", F.bround(det, 2).alias("detected_price_inr"),
        var.alias("variance_inr"),
        F.when(det.isNull(), "not_observable").when(F.abs(var) <= tolerance, "compliant").otherwise("non_compliant").alias("status"))


def price_exceptions(lines: DataFrame, first: int = 20) -> DataFrame:
    """The first price lines of a scan, whatever their status, as the report lists them."""
    rn = F.row_number().over(Window.partitionBy("scan_id").orderBy("pos"))
    label = F.substring(F.trim(F.concat(F.coalesce("brand", F.lit("")), F.lit(" "), F.coalesce("product_name", F.lit("")))), 1, 32)
    return lines.withColumn("line_no", rn).where(F.col("line_no") <= first).select(
        "scan_id", "line_no", label.alias("product"), "expected_price_inr", "detected_price_inr", "variance_inr", "status")


def price_summary(lines: DataFrame) -> DataFrame:
    agg = lines.groupBy("scan_id").agg(
        F.count_if(F.col("status") != "not_observable").alias("checked_tags"),
        F.count_if(F.col("status") == "compliant").alias("compliant_tags"))
    seen = F.col("checked_tags") > 0
    return agg.withColumn("compliance_percent", F.when(
        seen, F.bround(F.col("compliant_tags") / F.col("checked_tags") * 100.0, 1))).withColumn(
        "state", F.when(seen, "available").otherwise("not_observable"))


def evidence_state(qty: Column, expected: Column, missing: Column, resolved: Column, covered: Column, confirmed: Column) -> Column:
    """A missing detection alone never proves an inventory stock-out."""
    return (
        F.when(confirmed & expected & (qty <= 0), "confirmed_inventory_stockout")
        .when(~covered, "not_observed")
        .when(missing & expected & resolved, "verified_shelf_absence")
        .when(expected & (qty <= 0) & ~resolved, "suspected_shelf_gap")
        .when((qty <= 0) & ~expected, "suspected_shelf_gap")
        .otherwise("not_observed"))


def evidence_counts(rows: DataFrame) -> DataFrame:
    """``rows`` = (scan_id, state): counts per evidence state."""
    count = lambda s: F.count_if(F.col("state") == s)
    va, ci = count("verified_shelf_absence"), count("confirmed_inventory_stockout")
    return rows.groupBy("scan_id").agg(
        va.alias("verified_shelf_absence_count"), ci.alias("confirmed_inventory_stockout_count"),
        count("suspected_shelf_gap").alias("suspected_shelf_gap_count"), count("not_observed").alias("not_observed_count"),
        (va + ci).alias("confirmed_oos_count"))


def _impact(rows: DataFrame) -> DataFrame:
    """``rows`` = (scan_id, oos, oos_cash, risk, risk_cash, priced): totals and the status ladder."""
    agg = rows.groupBy("scan_id").agg(
        F.count_if("oos").alias("oos_sku_count"), F.count_if("risk").alias("at_risk_sku_count"),
        F.sum((F.coalesce("oos_cash", F.lit(0.0)) + F.coalesce("risk_cash", F.lit(0.0))).cast("decimal(24,6)")).cast("double").alias("d"),
        F.bool_or("priced").alias("priced"))
    daily = F.bround("d", 0).cast("bigint")
    none = (daily <= 0) & (F.col("oos_sku_count") == 0) & (F.col("at_risk_sku_count") == 0)
    unpriced = ~F.col("priced")
    shown = F.when(none | unpriced, F.lit(0)).otherwise(daily)
    return agg.select(
        "scan_id", "oos_sku_count", "at_risk_sku_count", shown.alias("daily_inr"), (shown * 7).alias("weekly_inr"),
        (shown * 30).alias("monthly_inr"),
        F.when(unpriced, F.lit(1)).otherwise(F.lit(2)).alias("level"),
        F.when(unpriced, "not_estimated").otherwise("estimated").alias("estimate_status"))


def impact_from_lines(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Lost sales from comparison lines priced by their planned row (first row of brand and product)."""
    plan_key = plan.groupBy("scan_id", pair_key().alias("key")).agg(
        F.min_by(F.struct("mrp_inr", "avg_daily_sales"), "pos").alias("m")).select("scan_id", "key", "m.*")
    rows = lines.where(~F.coalesce("issue_type", F.lit("")).isin("correct", "ok")).withColumn(
        "key", pair_key("expected_brand", "expected_product")).join(plan_key, ["scan_id", "key"], "left")
    price = F.coalesce(F.nullif("mrp_inr", F.lit(0.0)), F.lit(DEFAULT_PRICE))
    speed = F.coalesce(F.nullif("avg_daily_sales", F.lit(0.0)), F.lit(UNITS_PER_DAY))
    priced = (F.coalesce("mrp_inr", F.lit(0.0)) != 0) | (F.coalesce("avg_daily_sales", F.lit(0.0)) != 0)
    exp = F.coalesce(F.nullif("expected_qty", F.lit(0)), F.lit(1))
    gap = F.greatest(F.lit(0), exp - F.coalesce("actual_qty", F.lit(0)))
    oos = F.coalesce(F.col("issue_type").isin(ABSENT), F.lit(False))
    risk = F.coalesce(F.col("issue_type").isin("qty_mismatch", "qty_issue") & (gap > 0), F.lit(False))
    return _impact(rows.select(
        "scan_id", oos.alias("oos"), F.when(oos & priced, speed * price).alias("oos_cash"), risk.alias("risk"),
        F.when(risk & priced, speed * price * (gap / F.greatest(exp, F.lit(1)))).alias("risk_cash"), priced.alias("priced")))


def impact_from_plan(plan: DataFrame, inventory: DataFrame) -> DataFrame:
    """Lost sales without comparison lines: planned rows against the first counted inventory row."""
    key = F.concat_ws("|", *[F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("")) for c in ("brand", "product_name", "variant")])
    inv = inventory.where(F.coalesce("counted_in_totals", F.lit(True))).groupBy("scan_id", key.alias("key")).agg(
        F.min_by("quantity", "pos").alias("found"))
    rows = plan.withColumn("key", key).join(inv, ["scan_id", "key"], "left")
    price = F.coalesce(F.nullif("mrp_inr", F.lit(0.0)), F.lit(DEFAULT_PRICE))
    speed = F.coalesce(F.nullif("avg_daily_sales", F.lit(0.0)), F.lit(UNITS_PER_DAY))
    priced = (F.coalesce("mrp_inr", F.lit(0.0)) != 0) | (F.coalesce("avg_daily_sales", F.lit(0.0)) != 0)
    exp = F.greatest(F.lit(1), F.coalesce("expected_qty", F.lit(1)))
    found = F.coalesce("found", F.lit(0))
    gap = F.greatest(F.lit(0), exp - found)
    oos, short, low = found <= 0, (found > 0) & (gap > 0), (found > 0) & (gap == 0) & (found < LOW_STOCK)
    cash = F.when(short, speed * price * (gap / exp)).when(low, price * (LOW_STOCK - found))
    return _impact(rows.select(
        "scan_id", oos.alias("oos"), F.when(oos & priced, speed * price).alias("oos_cash"), (short | low).alias("risk"),
        F.when(priced, cash).alias("risk_cash"), priced.alias("priced")))


def impact_from_inventory(inventory: DataFrame) -> DataFrame:
    """Without a planogram: default price and velocity, so the counts show but no money is claimed."""
    rows = inventory.where(F.coalesce("counted_in_totals", F.lit(True)))
    q = F.coalesce("quantity", F.lit(0))
    oos, low = q <= 0, (q > 0) & (q <= LOW_STOCK)
    return _impact(rows.select(
        "scan_id", oos.alias("oos"), F.when(oos, F.lit(UNITS_PER_DAY * DEFAULT_PRICE)).alias("oos_cash"), low.alias("risk"),
        F.when(low, (LOW_STOCK - q) * UNITS_PER_DAY * DEFAULT_PRICE * LOW_STOCK_FACTOR).alias("risk_cash"),
        F.lit(False).alias("priced")))


def enrich_with_value(impact: DataFrame, value: DataFrame) -> DataFrame:
    """Priced inventory lifts an unestimated impact to an estimate at level 2."""
    j = impact.join(value, "scan_id", "left")
    priced = F.coalesce("priced_sku_count", F.lit(0)) > 0
    return j.select(
        "scan_id", "daily_inr", F.when(priced, F.greatest("level", F.lit(2))).otherwise(F.col("level")).alias("level"),
        F.when(priced & (F.col("estimate_status") == "not_estimated"), "estimated").otherwise(F.col("estimate_status")).alias("estimate_status"),
        F.when(priced, F.col("visible_value_inr")).alias("visible_value_inr"),
        F.when(priced, F.col("value_gap_inr")).alias("value_gap_inr"),
        F.when(priced, "priced").otherwise("indicative").alias("confidence"))


def value_weighted_availability(rows: DataFrame, by: str) -> DataFrame:
    """Demand- and price-weighted share of available items; substitutes recover part of the loss."""
    w = (F.col("avg_daily_sales") * F.col("mrp_inr")).cast("decimal(24,6)")
    here = F.coalesce("actual_facings", F.lit(0)) > 0
    zero = F.lit(0).cast("decimal(24,6)")
    agg = rows.where(w.isNotNull()).groupBy(by).agg(
        F.sum(w).alias("w"), F.sum(F.when(here, w).otherwise(zero)).alias("wa"), F.sum(F.when(~here, w).otherwise(zero)).alias("lost"))
    return agg.select(
        by, F.bround(F.col("wa").cast("double") / F.nullif(F.col("w").cast("double"), F.lit(0.0)), 4).alias("value_availability"),
        F.bround(F.col("lost").cast("double"), 2).alias("gross_loss_inr"))


def substitution_adjusted(demand: DataFrame, subs: DataFrame) -> DataFrame:
    """Gross exposure, net revenue and net contribution after substitutes; gains are not clamped.

    ``demand`` = (scan_id, item, units, price, contribution) unserved units of an absent item;
    ``subs`` = (scan_id, item, units, price, contribution), one row per substitute item.
    """
    cash = lambda c: F.sum((F.col("units") * F.col(c)).cast("decimal(24,6)"))
    back = subs.groupBy("scan_id", "item").agg(cash("price").alias("rev_back"), cash("contribution").alias("con_back"))
    j = demand.join(back, ["scan_id", "item"], "left")
    zero = F.lit(0).cast("decimal(24,6)")
    amount = lambda c: (F.col("units") * F.col(c)).cast("decimal(24,6)")
    return j.groupBy("scan_id").agg(
        F.bround(F.sum(amount("price")).cast("double"), 2).alias("gross_exposure"),
        F.bround(F.sum(amount("price") - F.coalesce("rev_back", zero)).cast("double"), 2).alias("net_revenue"),
        F.bround(F.sum(amount("contribution") - F.coalesce("con_back", zero)).cast("double"), 2).alias("net_contribution"))


def presence_bounds(rows: DataFrame) -> DataFrame:
    """Lower and upper bound of presence when some items could not be verified."""
    p, u = F.count_if(F.col("state") == "present"), F.count_if(F.col("state") == "unverifiable")
    a, t = F.count_if(F.col("state") == "absent"), F.count("*")
    return rows.groupBy("scan_id").agg(
        F.bround(p / t, 4).alias("lower"), F.bround((p + a) / t, 4).alias("coverage"), F.bround((p + u) / t, 4).alias("upper"))


