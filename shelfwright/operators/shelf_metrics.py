"""Scan-level shelf metrics: inventory roll-up, shares, quality and execution score.

All operators aggregate on ``scan_id`` with map-side partial aggregation, so one scan holding a
large part of the rows costs no more than its distinct keys after the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions import keys as K
from shelfwright.functions.numbers import percentage

LOW_STOCK = 2
OCR_LOW_CONFIDENCE = 0.55

# Component weights of the execution score with and without a planogram.
WEIGHTS_WITH_PLAN = {"availability": 25, "planogram": 20, "facing": 15, "placement": 15, "share_of_facings": 10}
WEIGHTS_NO_PLAN = {"availability": 35, "facing": 35, "placement": 30}
MIN_WEIGHT_FRACTION = 0.8


def unidentified(brand: Column, product: Column) -> Column:
    b = F.lower(F.trim(F.coalesce(brand, F.lit(""))))
    p = F.lower(F.trim(F.coalesce(product, F.lit(""))))
    return b.isin("", "unknown", "n/a") | p.isin("", "unknown", "unidentified sku", "n/a")


def aggregate_inventory(facings: DataFrame) -> DataFrame:
    """Facings to SKU rows: count, mean confidence, last seen labels, first concrete variant, boxes.

    The box list is the only unbounded column; it lives in the row of its SKU, never the whole scan.
    """
    brand, product = K.text_or(F.col("brand"), "Unknown"), K.text_or(F.col("product_name"), "Unknown")
    sku = F.lower(F.trim(F.coalesce(F.col("sku"), F.lit(""))))
    pkey, vkey = K.product_key(product), K.variant_key(F.col("variant"))
    stem = F.array_join(F.slice(F.split(pkey, " "), 1, 5), " ")
    in_family = F.lit(False)
    for token in K.STEM_FAMILIES:
        in_family = in_family | pkey.contains(token)
    key = (
        F.when(sku != "", F.concat(F.lit("s|"), sku))
        .when(in_family, F.concat(F.lit("f|"), stem))
        .otherwise(F.concat_ws("|", F.lit("p"), pkey, vkey))
    )
    excluded = F.coalesce(F.col("exclude_from_inventory"), F.lit(False))
    rows = facings.select(
        "scan_id", "pos", K.brand_key(brand, product).alias("brand_key"), key.alias("item_key"),
        excluded.alias("excluded"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.struct(
            K.brand_label(brand, product).alias("brand"), K.product_label(product).alias("product_name"),
            F.coalesce("category", F.lit("General")).alias("category"),
            F.coalesce("sku", F.lit("")).alias("sku"),
        ).alias("labels"),
        F.when(vkey != "", F.trim("variant")).alias("variant"),
    )
    out = rows.groupBy("scan_id", "brand_key", "item_key", "excluded").agg(
        F.count("*").alias("quantity"),
        F.sum(F.col("confidence").cast("decimal(20,6)")).alias("conf_sum"),
        F.max_by("labels", "pos").alias("labels"),
        F.min_by("variant", F.when(F.col("variant").isNotNull(), F.col("pos"))).alias("variant"),
        F.min("pos").alias("pos"),
    )
    qty = F.col("quantity")
    return out.select(
        "scan_id", "labels.brand", "labels.product_name", F.coalesce("variant", F.lit("")).alias("variant"),
        "labels.category", "labels.sku", "quantity", qty.alias("facings"),
        F.bround(F.col("conf_sum").cast("double") / qty, 4).alias("confidence"),
        (~F.col("excluded")).alias("counted_in_totals"),
        F.when(~F.col("excluded") & (qty <= LOW_STOCK), "low_stock").otherwise("in_stock").alias("stock_status"),
        F.when(F.col("excluded") | unidentified(F.col("labels.brand"), F.col("labels.product_name")), "needs_review")
        .otherwise("ok").alias("compliance_status"),
        "pos",
    )


def merge_inventory_rows(inventory: DataFrame) -> DataFrame:
    """One row per loose SKU key: quantities add up, the best confidence stays."""
    brand, product = K.text_or(F.col("brand"), "Unknown"), K.text_or(F.col("product_name"), "Unknown")
    qty = F.greatest(F.lit(0), F.coalesce(F.nullif("quantity", F.lit(0)), "facings", F.lit(0)))
    keyed = inventory.select(
        "scan_id", "pos", K.brand_key(brand, product).alias("bk"), K.product_key(product).alias("pk"),
        K.variant_merge_key(F.col("variant")).alias("vk"), qty.alias("qty"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.struct(K.brand_label(brand, product).alias("brand"), K.product_label(product).alias("product_name"),
                 K.variant_label(F.col("variant")).alias("variant")).alias("first"),
    )
    return keyed.groupBy("scan_id", "bk", "pk", "vk").agg(
        F.sum("qty").alias("quantity"), F.max("confidence").alias("confidence"),
        F.min_by("first", "pos").alias("first"),
    ).select("scan_id", "first.*", "quantity", F.col("quantity").alias("facings"), "confidence")


def brand_share(inventory: DataFrame, exclude_mismatch: bool = False) -> DataFrame:
    """Share of facings per brand; unclassified rows stay in the denominator as their own row."""
    qty = F.coalesce(F.nullif("quantity", F.lit(0)), "facings", F.lit(0))
    rows = inventory.where(qty > 0)
    if exclude_mismatch:
        rows = rows.where(F.lower(F.coalesce("compliance_status", F.lit(""))) != "category_mismatch")
    unclassified = K.is_unclassified(F.col("brand"))
    per_brand = rows.groupBy(
        "scan_id", F.when(unclassified, "Unclassified").otherwise(F.trim("brand")).alias("brand"),
        unclassified.alias("is_unclassified"),
    ).agg(F.sum(qty).alias("quantity"))
    total = F.sum("quantity").over(Window.partitionBy("scan_id"))  # one row per brand by now
    return per_brand.withColumn("share", F.bround(F.col("quantity") / total * 100.0, 1))


def top_per_scan(df: DataFrame, k: int, *order: Column, by: str = "scan_id", rank: str = "rank") -> DataFrame:
    """First k rows of each group; Spark limits each partition before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def brand_share_payload(inventory: DataFrame, audited: bool) -> DataFrame:
    """Denominator, unclassified part and number of brands in the audited or the full scope."""
    counted = inventory.where(F.coalesce("counted_in_totals", F.lit(True)))
    shares = brand_share(counted, exclude_mismatch=audited)
    unc = F.sum(F.when(F.col("is_unclassified"), F.col("quantity")).otherwise(0))
    return shares.groupBy("scan_id").agg(
        F.sum("quantity").alias("denominator"), unc.alias("unclassified_facings"),
        F.bround(unc / F.sum("quantity") * 100.0, 1).alias("unclassified_share_percent"),
        F.count_distinct(F.when(~F.col("is_unclassified"), F.lower("brand"))).alias("identified_brands"),
    ).withColumn("scope", F.lit("eligible_category" if audited else "full_image"))


def category_breakdown(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(
        "scan_id", F.coalesce(F.nullif("category", F.lit("")), F.lit("General")).alias("category")
    ).agg(F.sum("quantity").alias("count"))


def competitor_intel(shares: DataFrame, configured: DataFrame) -> DataFrame:
    """Own share against configured competitors; ``configured`` = (brand, is_primary), a small table."""
    wanted = configured.where(~K.is_unclassified(F.col("brand"))).select(
        F.lower(F.trim("brand")).alias("k"), F.trim("brand").alias("wanted"), "is_primary")
    scans = shares.select("scan_id").distinct()
    # Only scans x configured brands that occur are joined; absent brands count as share 0.
    hits = shares.where(~F.col("is_unclassified")).withColumn("k", F.lower(F.trim("brand"))).join(wanted, "k")
    agg = hits.groupBy("scan_id").agg(
        F.coalesce(F.max(F.when(F.col("is_primary"), F.col("share"))), F.lit(0.0)).alias("own_brand_share_percent"),
        F.count_if(~F.col("is_primary") & (F.col("share") > 0)).alias("competitors_detected"),
        F.bround(F.sum(F.when(~F.col("is_primary"), F.col("share").cast("decimal(10,1)"))).cast("double"), 1)
        .alias("competitor_share_sum"),
    )
    return scans.join(agg, "scan_id", "left").select(
        "scan_id", F.coalesce("own_brand_share_percent", F.lit(0.0)).alias("own_brand_share_percent"),
        F.coalesce("competitors_detected", F.lit(0)).alias("competitors_detected"),
        F.coalesce("competitor_share_sum", F.lit(0.0)).alias("competitor_share_sum"),
    )


def facing_quality(facings: DataFrame) -> DataFrame:
    """Text-reading health of a scan: empty, weak and mean confidence."""
    conf = F.coalesce("ocr_confidence", F.lit(0.0))
    empty = F.length(F.trim(F.coalesce("pack_text", F.lit("")))) < 3
    return facings.groupBy("scan_id").agg(
        F.count_if(empty).alias("ocr_empty_facings"),
        F.count_if(~empty & (conf < OCR_LOW_CONFIDENCE)).alias("ocr_low_confidence_facings"),
        F.bround(F.coalesce(F.avg(F.when(conf > 0, conf.cast("decimal(20,6)"))).cast("double"), F.lit(0.0)), 4)
        .alias("ocr_avg_confidence"),
    )


def shelf_utilization(facings: DataFrame, width: int, height: int) -> DataFrame:
    area = F.greatest(F.lit(0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0), F.col("y2") - F.col("y1"))
    return facings.groupBy("scan_id").agg(
        F.bround(F.least(F.lit(100.0), F.sum(area.cast("bigint")) / float(max(width * height, 1)) * 100.0), 2)
        .alias("shelf_utilization_percent"))


def scan_metrics(inventory: DataFrame, facings: DataFrame) -> DataFrame:
    """Core counters and percentages of every scan from its inventory and its facings."""
    counted = F.coalesce("counted_in_totals", F.lit(True))
    qty = F.coalesce("quantity", F.lit(0))
    inv = inventory.groupBy("scan_id").agg(
        F.sum(F.when(counted, qty).otherwise(0)).alias("total_products"),
        F.count_if(counted).alias("unique_skus"),
        F.count_distinct(F.when(counted & ~K.is_unclassified(F.col("brand")), F.col("brand"))).alias("unique_brands"),
        F.count_if(counted & (qty > 0) & (qty <= LOW_STOCK)).alias("low_stock_products"),
        F.count_if(counted & (qty == 0)).alias("out_of_stock_products"),
        F.count_if(F.col("compliance_status") == "category_mismatch").alias("mismatch_skus"),
    )
    brand, product = F.lower(F.trim(F.coalesce("brand", F.lit("")))), F.lower(F.trim(F.coalesce("product_name", F.lit(""))))
    excluded = F.coalesce("exclude_from_inventory", F.lit(False))
    review = excluded | brand.isin("", "unknown") | product.isin("", "unknown", "unidentified sku")
    fac = facings.groupBy("scan_id").agg(
        F.count("*").alias("total_facings"), F.count_if(review).alias("needs_review_facings"),
        F.count_if(excluded).alias("excluded_facings"),
    )
    both = inv.join(fac, "scan_id", "full")
    low = F.coalesce("low_stock_products", F.lit(0)) / F.greatest(F.coalesce("unique_skus", F.lit(0)), F.lit(1)) * 100.0
    seen, total = F.coalesce("needs_review_facings", F.lit(0)), F.coalesce("total_facings", F.lit(0))
    return both.select(
        "scan_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in inv.columns[1:] + fac.columns[1:]],
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - low * 0.6)), 1).alias("availability_percent"),
        F.bround(F.greatest(F.lit(0), total - seen) / F.greatest(total, F.lit(1)) * 100.0, 1)
        .alias("recognition_coverage_percent"),
    )


def placement_metrics(metrics: DataFrame, misplaced: str = "misplaced_facings", plan: str = "planogram_percent") -> DataFrame:
    """Placement and facing compliance, and the health score lowered by misplaced facings."""
    den = F.greatest(F.col("total_facings"), F.lit(1))
    placement = F.bround(F.greatest(F.lit(0.0), 100.0 - F.col(misplaced) / den * 100.0), 1)
    facing = F.when(F.col(plan).isNull(), placement).otherwise(F.bround((placement + F.col(plan)) / 2.0, 1))
    penalty = F.least(F.lit(10.0), F.col(misplaced) / den * 100.0 * 0.1)
    health = F.bround(F.col("availability_percent"), 2)
    return metrics.withColumn("placement_compliance_percent", placement).withColumn(
        "facing_compliance_percent", facing).withColumn(
        "shelf_health_score",
        F.when(F.col(misplaced) > 0, F.bround(F.greatest(F.lit(0.0), health - penalty), 2)).otherwise(health))


def execution_score(metrics: DataFrame) -> DataFrame:
    """Weighted mean over the available components, withheld below 80 % of the planned weight."""
    configured = F.col("planogram_configured")
    has = F.col("has_facings")

    def weight(name: str) -> Column:
        return F.when(configured, F.lit(float(WEIGHTS_WITH_PLAN[name]))).otherwise(
            F.lit(float(WEIGHTS_NO_PLAN.get(name, 0))))

    parts = {
        "availability": F.col("availability_percent"),
        "planogram": F.when(configured, F.col("planogram_percent")),
        "facing": F.when(has, F.col("facing_compliance_percent")),
        "placement": F.when(has, F.col("placement_compliance_percent")),
    }
    scored = {n: F.bround(v, 1) for n, v in parts.items()}
    used = sum((F.when(v.isNotNull(), weight(n)).otherwise(0.0) for n, v in scored.items()), F.lit(0.0))
    planned = F.when(configured, F.lit(float(sum(WEIGHTS_WITH_PLAN.values())))).otherwise(
        F.lit(float(sum(WEIGHTS_NO_PLAN.values()))))
    score = sum((F.coalesce(v * weight(n) / used, F.lit(0.0)) for n, v in scored.items()), F.lit(0.0))
    ok = (used > 0) & (used / planned >= MIN_WEIGHT_FRACTION)
    return metrics.select(
        "scan_id",
        F.when(ok, F.bround(score, 1)).alias("execution_score"),
        F.when(ok, "available").otherwise("not_configured").alias("score_state"),
        F.bround(used / planned * 100.0, 1).alias("assessment_coverage_percent"),
    )


def identity_keys(products: DataFrame, *keep: str) -> DataFrame:
    """Keys of what a row identifies; rows with neither SKU nor variant stay apart, and a missing identity is null."""
    ident = K.product_identity(F.col("brand"), F.col("product_name"), F.col("variant"), F.col("sku"))
    loose = K.is_placeholder(F.col("sku")) & K.is_placeholder(F.col("variant"))
    row_key = F.concat(ident, F.lit("|row:"), F.col("pos").cast("string"))
    known = F.upper(F.coalesce("product_status", F.lit("IDENTIFIED"))) != "UNVERIFIABLE"
    brand_ok = ~K.is_placeholder(F.col("brand")) & (F.upper(F.coalesce("brand_status", F.lit("IDENTIFIED"))) != "UNVERIFIABLE")
    return products.select(
        "scan_id", *keep,
        F.when(known & (ident != ""), F.when(loose, row_key).otherwise(ident)).alias("product_key"),
        F.when(brand_ok, K.brand_key(F.col("brand"))).alias("brand_key"),
        F.when(known, F.when((ident == "") | loose, row_key).otherwise(ident)).alias("variant_key"),
        loose.alias("loose"),
    )


def distinct_identities(products: DataFrame) -> DataFrame:
    """Distinct products, brands and variants of each scan."""
    return identity_keys(products).groupBy("scan_id").agg(
        F.count_distinct("product_key").alias("products_identified"),
        F.count_distinct("brand_key").alias("brands_identified"),
        F.count_distinct("variant_key").alias("variants_identified"),
    )


def identity_sketches(products: DataFrame, log2_size: int = 12) -> DataFrame:
    """(scan_id, products, brands): a sketch of the identities of each scan, to be stored with it and rolled up to any level.

    A sketch has at most 2 ** ``log2_size`` cells. Rows that stay apart in a scan are of that scan only, so their keys name it.
    """
    keys = identity_keys(products)
    own = F.when(F.col("loose"), F.concat(F.col("product_key"), F.lit("|"), F.col("scan_id").cast("string"))).otherwise(F.col("product_key"))
    return keys.groupBy("scan_id").agg(F.hll_sketch_agg(own, log2_size).alias("products"), F.hll_sketch_agg("brand_key", log2_size).alias("brands"))


def rolled_up(sketches: DataFrame, *by: str, log2_size: int = 12) -> DataFrame:
    """Distinct products and brands of ``by`` from the sketches of their scans, and the standard error to expect of them (as a share).

    Only sketches are shuffled; those of a level can be rolled up again.
    """
    u = sketches.groupBy(*by).agg(F.hll_union_agg("products").alias("products"), F.hll_union_agg("brands").alias("brands"))
    error = 1.04 / 2 ** (log2_size / 2)
    return u.select(*by, "products", "brands", F.hll_sketch_estimate("products").alias("products_about"), F.hll_sketch_estimate("brands").alias("brands_about"), F.lit(error).alias("relative_error"))


def shelf_only_brands(products: DataFrame) -> DataFrame:
    """Brand shares and ranks by facings and by visible units, over brands of a scan."""
    per = products.withColumn("brand_key", K.brand_key(F.col("brand"))).where(F.col("brand_key") != "").groupBy(
        "scan_id", "brand_key").agg(
        F.sum(F.coalesce("actual_facings", F.lit(0))).alias("actual_facings"),
        F.sum(F.coalesce("actual_visible_units", F.lit(0))).alias("actual_visible_units"),
    )
    scan = Window.partitionBy("scan_id")
    tot_f, tot_u = F.sum("actual_facings").over(scan), F.sum("actual_visible_units").over(scan)
    out = per.select(
        "*", percentage(F.col("actual_facings"), tot_f).alias("share_of_facings_percent"),
        percentage(F.col("actual_visible_units"), tot_u).alias("share_of_visible_units_percent"),
        F.row_number().over(scan.orderBy(F.desc("actual_facings"), "brand_key")).alias("rank_by_facings"),
        F.row_number().over(scan.orderBy(F.desc("actual_visible_units"), "brand_key")).alias("rank_by_visible_units"),
        tot_f.alias("_t"),
    )
    return out.where(F.col("_t") > 0).drop("_t")


def recognition_mix(facings: DataFrame) -> DataFrame:
    sources = ["catalog", "ocr", "model", "vector"]
    src = F.lower(F.coalesce("recognition_source", F.lit("")))
    return facings.groupBy("scan_id").agg(
        *[F.count_if(src == s).alias(f"n_{s}") for s in sources], F.count("*").alias("n_total"))
