"""Row formulas and roll-ups over planned rows joined with what was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions import keys as K
from shelfwright.functions import numbers as N


def row_metrics(rows: DataFrame) -> DataFrame:
    """Variance, compliance, shortfall, value gap, coverage days and range status of each row."""
    a, e = F.col("actual_facings"), F.col("expected_facings")
    u, x = F.col("actual_visible_units"), F.col("expected_shelf_units")
    short = N.shortfall(u, x)
    return rows.withColumns({
        "facing_variance": N.facing_variance(a, e),
        "facing_variance_percent": N.percentage(a - e, e),
        "facing_compliance": N.percentage(a, e),
        "shelf_unit_variance": u - x,
        "shelf_unit_compliance": N.percentage(u, x),
        "visible_unit_shortfall": short,
        "value_gap_inr": N.value_gap(short, F.col("mrp_inr")),
        "coverage_days": N.coverage_days(u, F.col("avg_daily_sales")),
        "min_max_status": N.min_max_status(a, F.col("min_facings"), F.col("max_facings")),
    })


def row_checks(rows: DataFrame) -> DataFrame:
    """Passed and applicable checks per row: presence, facings, range, shelf units."""
    present = ~F.coalesce("match_status", F.lit("")).isin("NOT_FOUND", "UNVERIFIABLE")
    a, e = F.col("actual_facings"), F.col("expected_facings")
    u, x = F.col("actual_visible_units"), F.col("expected_shelf_units")
    lo, hi = F.col("min_facings"), F.col("max_facings")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    has_f, has_r, has_u = one(e > 0), one(lo.isNotNull() | hi.isNotNull()), one(x > 0)
    in_range = N.min_max_status(a, lo, hi).isin("WITHIN_RANGE", "MEETS_MIN", "WITHIN_MAX", "NO_RANGE")
    passed = 1 + has_f * one(a >= e) + has_r * one(in_range) + has_u * one(u >= x)
    return rows.select(
        "scan_id", "pos", F.when(present, passed).otherwise(0).alias("passed"),
        F.when(present, 1 + has_f + has_r + has_u).otherwise(1).alias("applicable"))


def check_compliance(rows: DataFrame) -> DataFrame:
    """Share of passed checks over all applicable checks of a scan."""
    agg = row_checks(rows).groupBy("scan_id").agg(F.sum("passed").alias("passed"), F.sum("applicable").alias("applicable"))
    return agg.withColumn("planogram_compliance", N.percentage(F.col("passed"), F.col("applicable")))


def facing_compliance_total(rows: DataFrame) -> DataFrame:
    both = F.col("actual_facings").isNotNull() & F.col("expected_facings").isNotNull()
    agg = rows.groupBy("scan_id").agg(
        F.coalesce(F.sum(F.when(both, F.col("actual_facings"))), F.lit(0)).alias("actual_sum"),
        F.coalesce(F.sum(F.when(both, F.col("expected_facings"))), F.lit(0)).alias("expected_sum"))
    return agg.withColumn("overall_facing_compliance", N.percentage(F.col("actual_sum"), F.col("expected_sum")))


def _share_table(rows: DataFrame, unplanned: DataFrame, key: Column) -> DataFrame:
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    planned = rows.select("scan_id", key.alias("k"), pos("expected_facings").alias("e"), pos("actual_facings").alias("a"),
                          F.col("actual_facings").isNotNull().alias("seen"))
    extra = unplanned.select("scan_id", key.alias("k"), F.lit(None).cast("int").alias("e"), pos("actual_facings").alias("a"),
                             (F.col("actual_facings") > 0).alias("seen"))
    return planned.unionByName(extra).groupBy("scan_id", "k").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), F.bool_or("seen").alias("seen"))


def brand_plan_share(rows: DataFrame, unplanned: DataFrame) -> DataFrame:
    """Expected against actual share per brand; unplanned facings count on the actual side."""
    agg = _share_table(rows, unplanned, K.brand_key(F.col("brand"))).where(
        (F.col("k") != "") & (F.col("e").isNotNull() | F.col("a").isNotNull()))
    scan = Window.partitionBy("scan_id")
    e, a = F.coalesce("e", F.lit(0)), F.coalesce("a", F.lit(0))
    out = agg.select(
        "scan_id", F.col("k").alias("brand"), e.alias("expected_facings"), a.alias("actual_facings"),
        N.percentage(e, F.sum(e).over(scan)).alias("expected_share_percent"),
        N.percentage(a, F.sum(a).over(scan)).alias("actual_share_percent"))
    diff_a, diff_e = F.col("actual_share_percent"), F.col("expected_share_percent")
    return out.withColumn("share_variance_pp", F.bround(diff_a - diff_e, 1)).withColumn(
        "status", F.when(diff_a + 0.5 < diff_e, "UNDER_SHARE").when(diff_a > diff_e + 0.5, "OVER_SHARE").otherwise("OK"))


def group_plan_share(rows: DataFrame, unplanned: DataFrame) -> DataFrame:
    """Category and sub-category shares in one pass over grouping sets."""
    lab = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unspecified"))
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    planned = rows.select("scan_id", lab("category").alias("category"), lab("sub_category").alias("subcategory"),
                          pos("expected_facings").alias("e"), F.greatest("actual_facings", F.lit(0)).alias("a0"),
                          F.col("actual_facings").isNotNull().alias("seen"))
    extra = unplanned.where("actual_facings > 0").select(
        "scan_id", lab("category").alias("category"), lab("sub_category").alias("subcategory"),
        F.lit(None).cast("int").alias("e"), F.col("actual_facings").alias("a0"), F.lit(True).alias("seen"))
    both = planned.unionByName(extra).withColumn("a", F.when(F.col("seen"), F.col("a0")))
    agg = both.groupingSets([["scan_id", "category"], ["scan_id", "subcategory"]], "scan_id", "category", "subcategory").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), F.grouping("category").alias("g"))
    agg = agg.where(F.col("e").isNotNull() | F.col("a").isNotNull())
    scope = Window.partitionBy("scan_id", "g")
    e, a = F.coalesce("e", F.lit(0)), F.coalesce("a", F.lit(0))
    return agg.select(
        "scan_id", F.when(F.col("g") == 0, "category").otherwise("subcategory").alias("level"),
        F.coalesce("category", "subcategory").alias("label"), e.alias("expected_facings"), F.col("a").alias("actual_facings"),
        N.percentage(e, F.sum(e).over(scope)).alias("expected_share_percent"),
        F.when(F.col("a").isNotNull(), N.percentage(a, F.sum(a).over(scope))).alias("actual_share_percent"))


def inventory_value(rows: DataFrame) -> DataFrame:
    """Visible, expected and missing value on rows with a price; null where nothing is priced."""
    price = F.col("mrp_inr")
    u, x = F.col("actual_visible_units"), F.col("expected_shelf_units")
    cash = lambda units: (units * N.money(price)).cast("decimal(28,2)")
    agg = rows.groupBy("scan_id").agg(
        F.count(price).alias("priced_sku_count"), F.sum(cash(u)).alias("v"), F.sum(cash(x)).alias("e"),
        F.sum(cash(N.shortfall(u, x))).alias("g"))
    val = lambda c: F.when(F.col("priced_sku_count") > 0, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return agg.select("scan_id", "priced_sku_count", val("v").alias("visible_value_inr"),
                      val("e").alias("expected_value_inr"), val("g").alias("value_gap_inr"))


def presence_only(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Facing metrics become NOT_APPLICABLE for documents without facing targets."""
    targets = rows.groupBy("scan_id").agg(F.bool_or(F.col("expected_facings") > 1).alias("has_targets"))
    flag = documents.join(targets, "scan_id", "left").select(
        "scan_id", ((F.lower(F.coalesce("document_type", F.lit(""))) == "planogram")
                    | F.coalesce("has_targets", F.lit(False))).alias("sets_facings"))
    out = rows.join(flag, "scan_id", "left").withColumn("sets_facings", F.coalesce("sets_facings", F.lit(False)))
    return out.select(
        "scan_id", "pos", "sets_facings",
        F.when(F.col("sets_facings"), N.percentage(F.col("actual_facings"), F.col("expected_facings"))).alias("facing_compliance"),
        F.when(~F.col("sets_facings"), "NOT_APPLICABLE").when(
            F.col("actual_facings").isNull() | (F.coalesce("expected_facings", F.lit(0)) == 0), "UNAVAILABLE")
        .otherwise("CALCULATED").alias("status"))
