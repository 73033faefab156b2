"""Queries: inventory roll-up, shares, scan metrics, score."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright.operators import shelf_metrics as M
from shelfwright.plans.registry import query

UNCL = "('', 'unknown', 'unidentified', 'unclassified', 'n/a', 'unidentified sku')"
OWN = {
    "share_rows": f"""SELECT scan_id, CASE WHEN lower(trim(brand)) IN {UNCL} THEN 'Unclassified' ELSE trim(brand) END AS brand,
        lower(trim(brand)) IN {UNCL} AS is_unclassified, CASE WHEN quantity = 0 THEN facings ELSE quantity END AS q,
        counted_in_totals, compliance_status FROM inv WHERE CASE WHEN quantity = 0 THEN facings ELSE quantity END > 0""",
    "share_all": """SELECT scan_id, brand, is_unclassified, sum(q) AS quantity,
        round_even(sum(q) / sum(sum(q)) OVER (PARTITION BY scan_id) * 100.0e0, 1) AS share
        FROM share_rows GROUP BY scan_id, brand, is_unclassified""",
    "inv_agg": """SELECT scan_id, sum(CASE WHEN counted_in_totals THEN quantity ELSE 0 END) AS total_products,
        count(*) FILTER (counted_in_totals) AS unique_skus,
        count(DISTINCT CASE WHEN counted_in_totals AND brand <> 'Unknown' THEN brand END) AS unique_brands,
        count(*) FILTER (counted_in_totals AND quantity > 0 AND quantity <= 2) AS low_stock_products,
        count(*) FILTER (counted_in_totals AND quantity = 0) AS out_of_stock_products,
        count(*) FILTER (compliance_status = 'category_mismatch') AS mismatch_skus FROM inv GROUP BY scan_id""",
    "fac_agg": """SELECT scan_id, count(*) AS total_facings,
        count(*) FILTER (exclude_from_inventory OR brand = 'Unknown') AS needs_review_facings,
        count(*) FILTER (exclude_from_inventory) AS excluded_facings FROM fac GROUP BY scan_id""",
    "core": """SELECT coalesce(i.scan_id, f.scan_id) AS scan_id,
        coalesce(total_products, 0) AS total_products, coalesce(unique_skus, 0) AS unique_skus,
        coalesce(unique_brands, 0) AS unique_brands, coalesce(low_stock_products, 0) AS low_stock_products,
        coalesce(out_of_stock_products, 0) AS out_of_stock_products, coalesce(mismatch_skus, 0) AS mismatch_skus,
        coalesce(total_facings, 0) AS total_facings, coalesce(needs_review_facings, 0) AS needs_review_facings,
        coalesce(excluded_facings, 0) AS excluded_facings,
        round_even(greatest(0.0e0, least(100.0e0, 100.0e0 - coalesce(low_stock_products, 0) / greatest(coalesce(unique_skus, 0), 1) * 100.0e0 * 0.6e0)), 1) AS availability_percent,
        round_even(greatest(0, coalesce(total_facings, 0) - coalesce(needs_review_facings, 0)) / greatest(coalesce(total_facings, 0), 1) * 100.0e0, 1) AS recognition_coverage_percent
        FROM inv_agg i FULL JOIN fac_agg f ON i.scan_id = f.scan_id""",
}


@query("g5_brand_share", "SELECT * FROM share_all", OWN)
def g5(d):
    return M.brand_share(d.inv)


@query("w2_share_of_total", """SELECT scan_id, category, sum(facings) AS facings,
    round_even(sum(facings) / sum(sum(facings)) OVER (PARTITION BY scan_id) * 100.0e0, 1) AS share
    FROM inv GROUP BY scan_id, category""")
def w2(d):
    from pyspark.sql import Window
    per = d.inv.groupBy("scan_id", "category").agg(F.sum("facings").alias("facings"))
    total = F.sum("facings").over(Window.partitionBy("scan_id"))
    return per.withColumn("share", F.bround(F.col("facings") / total * 100.0, 1))


@query("t2_top_brands", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY quantity DESC, brand) AS rank
    FROM share_all WHERE NOT is_unclassified) WHERE rank <= 10""", OWN)
def t2(d):
    return M.top_per_scan(M.brand_share(d.inv).where(~F.col("is_unclassified")), 10, F.desc("quantity"), F.col("brand"))


@query("g6_share_payload", f"""SELECT scan_id, sum(q) AS denominator, sum(CASE WHEN is_unclassified THEN q ELSE 0 END) AS unclassified_facings,
    round_even(sum(CASE WHEN is_unclassified THEN q ELSE 0 END) / sum(q) * 100.0e0, 1) AS unclassified_share_percent,
    count(DISTINCT CASE WHEN NOT is_unclassified THEN lower(brand) END) AS identified_brands, scope
    FROM (SELECT *, 'eligible_category' AS scope FROM share_rows WHERE counted_in_totals AND compliance_status <> 'category_mismatch'
          UNION ALL SELECT *, 'full_image' FROM share_rows WHERE counted_in_totals) GROUP BY scan_id, scope""", OWN)
def g6(d):
    return M.brand_share_payload(d.inv, True).unionByName(M.brand_share_payload(d.inv, False))


@query("g7_category_breakdown", "SELECT scan_id, category, sum(quantity) AS count FROM inv GROUP BY scan_id, category")
def g7(d):
    return M.category_breakdown(d.inv)


@query("g8_competitor_intel", """SELECT scan_id,
    coalesce(max(CASE WHEN lower(brand) = 'brand#1' THEN share END), 0) AS own_brand_share_percent,
    count(*) FILTER (lower(brand) IN ('brand#2', 'brand#3', 'brand#4') AND share > 0) AS competitors_detected,
    coalesce(round_even(CAST(sum(CASE WHEN lower(brand) IN ('brand#2', 'brand#3', 'brand#4') THEN CAST(share AS DECIMAL(10,1)) END) AS DOUBLE), 1), 0) AS competitor_share_sum
    FROM share_all GROUP BY scan_id""", OWN)
def g8(d):
    # Configuration: the primary brand and its competitors, taken from the part table.
    conf = d.table("part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4")).select(
        F.col("p_brand").alias("brand"), (F.col("p_brand") == "Brand#1").alias("is_primary")).distinct()
    return M.competitor_intel(M.brand_share(d.inv), conf)


@query("g9_scan_metrics", "SELECT * FROM core", OWN)
def g9(d):
    return M.scan_metrics(d.inv, d.fac)


PLACED = {**OWN, "placed": """SELECT *, round_even(greatest(0.0e0, 100.0e0 - misplaced_facings / greatest(total_facings, 1) * 100.0e0), 1) AS placement_compliance_percent
    FROM (SELECT c.*, coalesce(m.n, 0) AS misplaced_facings, p.pct AS planogram_percent FROM core c
    LEFT JOIN (SELECT scan_id, count(*) FILTER (category = 'Dairy') AS n FROM fac GROUP BY scan_id) m ON c.scan_id = m.scan_id
    LEFT JOIN (SELECT scan_id, round_even(100.0e0 * count(*) FILTER (sku <> '') / count(*), 1) AS pct FROM plan GROUP BY scan_id
               HAVING count(*) FILTER (sku <> '') > 0) p ON c.scan_id = p.scan_id)""",
    "placed2": """SELECT *, CASE WHEN planogram_percent IS NULL THEN placement_compliance_percent
        ELSE round_even((placement_compliance_percent + planogram_percent) / 2.0e0, 1) END AS facing_compliance_percent,
    CASE WHEN misplaced_facings > 0 THEN round_even(greatest(0.0e0, round_even(availability_percent, 2)
        - least(10.0e0, misplaced_facings / greatest(total_facings, 1) * 100.0e0 * 0.1e0)), 2)
        ELSE round_even(availability_percent, 2) END AS shelf_health_score FROM placed"""}


def _placed(d):
    mis = d.fac.groupBy("scan_id").agg(F.count_if(F.col("category") == "Dairy").alias("misplaced_facings"))
    plan = d.plan.groupBy("scan_id").agg(
        F.count_if(F.col("sku") != "").alias("n"), F.count("*").alias("t")).where("n > 0").select(
        "scan_id", F.bround(F.lit(100.0) * F.col("n") / F.col("t"), 1).alias("planogram_percent"))
    base = M.scan_metrics(d.inv, d.fac).join(mis, "scan_id", "left").join(plan, "scan_id", "left").fillna(0, ["misplaced_facings"])
    return M.placement_metrics(base)


@query("g9_placement", "SELECT * FROM placed2", PLACED)
def g9b(d):
    return _placed(d)


@query("g12_execution_score", """SELECT scan_id, CASE WHEN used / planned >= 0.8e0 THEN round_even(score, 1) END AS execution_score,
    CASE WHEN used / planned >= 0.8e0 THEN 'available' ELSE 'not_configured' END AS score_state,
    round_even(used / planned * 100.0e0, 1) AS assessment_coverage_percent
    FROM (SELECT *, CASE WHEN conf THEN 85.0e0 ELSE 100.0e0 END AS planned,
      0.0e0 + availability_percent * wa / used + CASE WHEN conf THEN planogram_percent * 20.0e0 / used ELSE 0.0e0 END
      + CASE WHEN has THEN facing_compliance_percent * wf / used ELSE 0.0e0 END
      + CASE WHEN has THEN placement_compliance_percent * wp / used ELSE 0.0e0 END AS score
      FROM (SELECT *, wa + CASE WHEN conf THEN 20.0e0 ELSE 0.0e0 END + CASE WHEN has THEN wf + wp ELSE 0.0e0 END AS used
        FROM (SELECT *, planogram_percent IS NOT NULL AS conf, total_facings > 0 AS has,
          CASE WHEN planogram_percent IS NOT NULL THEN 25.0e0 ELSE 35.0e0 END AS wa,
          CASE WHEN planogram_percent IS NOT NULL THEN 15.0e0 ELSE 35.0e0 END AS wf,
          CASE WHEN planogram_percent IS NOT NULL THEN 15.0e0 ELSE 30.0e0 END AS wp FROM placed2)))""", PLACED)
def g12(d):
    return M.execution_score(_placed(d).withColumn("planogram_configured", F.col("planogram_percent").isNotNull())
                             .withColumn("has_facings", F.col("total_facings") > 0))


@query("g10_shelf_utilization", """SELECT scan_id, round_even(least(100.0e0, sum(CAST((x2 - x1) * (y2 - y1) AS BIGINT)) / 1080000.0e0 * 100.0e0), 2) AS shelf_utilization_percent
    FROM fac GROUP BY scan_id""")
def g10(d):
    return M.shelf_utilization(d.fac, 1200, 900)


@query("g11_text_quality", """SELECT scan_id, count(*) FILTER (length(trim(pack_text)) < 3) AS ocr_empty_facings,
    count(*) FILTER (length(trim(pack_text)) >= 3 AND ocr_confidence < 0.55e0) AS ocr_low_confidence_facings,
    round_even(coalesce(CAST(sum(CASE WHEN ocr_confidence > 0 THEN CAST(ocr_confidence AS DECIMAL(20,6)) END) AS DOUBLE)
      / nullif(count(*) FILTER (ocr_confidence > 0), 0), 0), 4) AS ocr_avg_confidence FROM fac GROUP BY scan_id""")
def g11(d):
    return M.facing_quality(d.fac)


@query("g1_aggregate_inventory", """SELECT scan_id, arg_max(brand, pos) AS brand, arg_max(product_name, pos) AS product_name,
    arg_min(variant, pos) AS variant, arg_max(category, pos) AS category, arg_max(sku, pos) AS sku, count(*) AS quantity, count(*) AS facings,
    round_even(CAST(sum(CAST(confidence AS DECIMAL(20,6))) AS DOUBLE) / count(*), 4) AS confidence, NOT exclude_from_inventory AS counted_in_totals,
    CASE WHEN NOT exclude_from_inventory AND count(*) <= 2 THEN 'low_stock' ELSE 'in_stock' END AS stock_status,
    CASE WHEN exclude_from_inventory OR brand = 'Unknown' THEN 'needs_review' ELSE 'ok' END AS compliance_status, min(pos) AS pos
    FROM fac GROUP BY scan_id, brand, CASE WHEN sku <> '' THEN lower(sku) ELSE product_name || '|' || variant END, exclude_from_inventory""")
def g1(d):
    return M.aggregate_inventory(d.fac)


@query("t1_inventory_order", """SELECT scan_id, brand, product_name, variant, counted_in_totals, quantity,
    row_number() OVER (PARTITION BY scan_id ORDER BY counted_in_totals DESC, quantity DESC, pos) AS rank FROM inv""")
def t1(d):
    from pyspark.sql import Window
    w = Window.partitionBy("scan_id").orderBy(F.desc("counted_in_totals"), F.desc("quantity"), "pos")
    return d.inv.select("scan_id", "brand", "product_name", "variant", "counted_in_totals", "quantity", F.row_number().over(w).alias("rank"))


@query("g2_merge_inventory", """SELECT scan_id, arg_min(brand, pos) AS brand, product_name, variant, sum(q) AS quantity, sum(q) AS facings, max(confidence) AS confidence
    FROM (SELECT scan_id, pos, brand, product_name, variant, 1 - l_discount AS confidence, l.qty AS q
      FROM (SELECT *, CASE WHEN ln = 7 THEN 'Unknown' ELSE p_brand END AS brand, p_name AS product_name,
            CASE WHEN ln = 3 THEN 'Regular, ' || p_type ELSE p_type END AS v0, p_type AS variant FROM base) l)
    GROUP BY scan_id, brand, product_name, variant""")
def g2(d):
    rows = d.base.select(
        "scan_id", "pos", F.when(F.col("ln") == 7, "Unknown").otherwise(F.col("p_brand")).alias("brand"),
        F.col("p_name").alias("product_name"), F.col("p_type").alias("variant"),
        F.col("qty").alias("quantity"), F.col("qty").alias("facings"), (1 - F.col("l_discount")).alias("confidence"))
    return M.merge_inventory_rows(rows)


IDENT = {"ident": """SELECT *, CASE WHEN lower(sku) <> '' THEN 'sku:' || lower(sku) ELSE
      concat_ws('|', replace(lower(brand), '#', ''), lower(product_name), CASE WHEN variant <> 'UNVERIFIABLE' THEN lower(variant) END) END AS ident,
      sku = '' AND variant = 'UNVERIFIABLE' AS loose FROM cv"""}


@query("g31_distinct_identities", """SELECT scan_id,
    count(DISTINCT CASE WHEN product_status <> 'UNVERIFIABLE' THEN CASE WHEN loose THEN ident || '|row:' || CAST(pos AS VARCHAR) ELSE ident END END) AS products_identified,
    count(DISTINCT CASE WHEN brand_status <> 'UNVERIFIABLE' THEN lower(brand) END) AS brands_identified,
    count(DISTINCT CASE WHEN product_status <> 'UNVERIFIABLE' THEN CASE WHEN loose THEN ident || '|row:' || CAST(pos AS VARCHAR) ELSE ident END END) AS variants_identified
    FROM ident GROUP BY scan_id""", IDENT)
def g31(d):
    return M.distinct_identities(d.cv)


@query("g31_sketch_rollup", """SELECT store_id, true AS products_within, true AS brands_within, count(DISTINCT scan_id) AS n_scans FROM (SELECT cv.scan_id, store_id FROM cv JOIN scans ON cv.scan_id = scans.scan_id) GROUP BY store_id""")
def g31b(d):
    """Stores from the sketches of their scans, against the exact counts: within four standard errors and one."""
    of = d.scans.select("scan_id", "store_id")
    about = M.rolled_up(M.identity_sketches(d.cv).join(of, "scan_id"), "store_id")
    keys = M.identity_keys(d.cv).join(of, "scan_id")
    own = F.when(F.col("loose"), F.concat("product_key", F.lit("|"), F.col("scan_id").cast("string"))).otherwise(F.col("product_key"))
    exact = keys.groupBy("store_id").agg(F.count_distinct(own).alias("p"), F.count_distinct("brand_key").alias("b"), F.count_distinct("scan_id").alias("n_scans"))
    near = lambda a, e: F.abs(F.col(a) - F.col(e)) <= 4 * F.col("relative_error") * F.col(e) + 1
    return exact.join(about, "store_id").select("store_id", near("products_about", "p").alias("products_within"), near("brands_about", "b").alias("brands_within"), "n_scans")


@query("v10_product_identity", "SELECT scan_id, pos, ident FROM ident", IDENT)
def v10(d):
    from shelfwright.functions import keys as K
    return d.cv.select("scan_id", "pos", K.product_identity(F.col("brand"), F.col("product_name"), F.col("variant"), F.col("sku")).alias("ident"))


SHELF_ONLY = """SELECT scan_id, brand_key, actual_facings, actual_visible_units,
    round_even(actual_facings / nullif(sum(actual_facings) OVER (PARTITION BY scan_id), 0) * 100.0e0, 1) AS share_of_facings_percent,
    round_even(actual_visible_units / nullif(sum(actual_visible_units) OVER (PARTITION BY scan_id), 0) * 100.0e0, 1) AS share_of_visible_units_percent,
    row_number() OVER (PARTITION BY scan_id ORDER BY actual_facings DESC, brand_key) AS rank_by_facings,
    row_number() OVER (PARTITION BY scan_id ORDER BY actual_visible_units DESC, brand_key) AS rank_by_visible_units
    FROM (SELECT scan_id, replace(lower(brand), '#', '') AS brand_key, sum(coalesce(actual_facings, 0)) AS actual_facings,
      sum(coalesce(actual_visible_units, 0)) AS actual_visible_units FROM cv GROUP BY scan_id, replace(lower(brand), '#', ''))
    QUALIFY sum(actual_facings) OVER (PARTITION BY scan_id) > 0"""


@query("g30_shelf_only_analysis", SHELF_ONLY)
def g30(d):
    return M.shelf_only_brands(d.cv)


@query("w1_brand_ranks", f"SELECT scan_id, brand_key, rank_by_facings, rank_by_visible_units FROM ({SHELF_ONLY})")
def w1(d):
    return M.shelf_only_brands(d.cv).select("scan_id", "brand_key", "rank_by_facings", "rank_by_visible_units")


@query("g42_recognition_mix", """SELECT scan_id, count(*) FILTER (recognition_source = 'catalog') AS n_catalog, count(*) FILTER (recognition_source = 'ocr') AS n_ocr,
    count(*) FILTER (recognition_source = 'model') AS n_model, count(*) FILTER (recognition_source = 'vector') AS n_vector, count(*) AS n_total FROM fac GROUP BY scan_id""")
def g42(d):
    return M.recognition_mix(d.fac)
