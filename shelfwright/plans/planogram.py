"""Queries: row formulas, plan shares, value, location, capture checks, money."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright.functions import location as L
from shelfwright.operators import capture as C
from shelfwright.operators import location as LO
from shelfwright.operators import money as MO
from shelfwright.operators import planogram_calc as P
from shelfwright.plans.registry import query
from shelfwright.session import cut_lineage

STATUS = """CASE WHEN actual_facings IS NULL THEN 'UNVERIFIABLE' WHEN min_facings IS NULL AND max_facings IS NULL THEN 'NO_RANGE'
    WHEN actual_facings < min_facings THEN 'BELOW_MIN' WHEN actual_facings > max_facings THEN 'ABOVE_MAX'
    WHEN min_facings IS NOT NULL AND max_facings IS NOT NULL THEN 'WITHIN_RANGE' WHEN min_facings IS NOT NULL THEN 'MEETS_MIN' ELSE 'WITHIN_MAX' END"""
OWN = {
    "rowm": f"""SELECT *, actual_facings - expected_facings AS facing_variance,
        round_even((actual_facings - expected_facings) / expected_facings * 100.0e0, 1) AS facing_variance_percent,
        round_even(actual_facings / expected_facings * 100.0e0, 1) AS facing_compliance,
        actual_visible_units - expected_shelf_units AS shelf_unit_variance,
        round_even(actual_visible_units / expected_shelf_units * 100.0e0, 1) AS shelf_unit_compliance,
        CASE WHEN expected_shelf_units IS NOT NULL THEN greatest(expected_shelf_units - coalesce(actual_visible_units, 0), 0) END AS visible_unit_shortfall,
        {STATUS} AS min_max_status FROM prows""",
    "rowm2": """SELECT *, round_even(visible_unit_shortfall * mrp_inr, 2) AS value_gap_inr,
        CASE WHEN avg_daily_sales > 0 THEN round_even(actual_visible_units / avg_daily_sales, 1) END AS coverage_days FROM rowm""",
    "checks": """SELECT scan_id, pos, CASE WHEN present THEN 1 + hf * CAST(coalesce(actual_facings >= expected_facings, false) AS INT)
        + hr * CAST(min_max_status IN ('WITHIN_RANGE', 'MEETS_MIN', 'WITHIN_MAX', 'NO_RANGE') AS INT)
        + hu * CAST(coalesce(actual_visible_units >= expected_shelf_units, false) AS INT) ELSE 0 END AS passed,
        CASE WHEN present THEN 1 + hf + hr + hu ELSE 1 END AS applicable
        FROM (SELECT *, match_status NOT IN ('NOT_FOUND', 'UNVERIFIABLE') AS present, CAST(expected_facings > 0 AS INT) AS hf,
              CAST(min_facings IS NOT NULL OR max_facings IS NOT NULL AS INT) AS hr, CAST(coalesce(expected_shelf_units > 0, false) AS INT) AS hu FROM rowm)""",
    "combo": """SELECT scan_id, replace(lower(brand), '#', '') AS k, category, sub_category, expected_facings AS e, CASE WHEN actual_facings > 0 THEN actual_facings END AS a,
        greatest(actual_facings, 0) AS a0, actual_facings IS NOT NULL AS seen FROM prows
        UNION ALL SELECT scan_id, replace(lower(brand), '#', ''), category, sub_category, NULL, CASE WHEN actual_facings > 0 THEN actual_facings END, actual_facings, actual_facings > 0
        FROM cv WHERE ln = 7""",
    "norm": """SELECT scan_id, pos, replace(replace(upper(location_label), ' ', ''), 'X', 'X') AS label, rack_marker AS rack, brand, product_name, variant,
        actual_facings, actual_visible_units, visible_price FROM cv""",
    "roll": """SELECT scan_id, label, arg_min(rack, pos) FILTER (rack IS NOT NULL) AS rack_marker, CASE WHEN contains(label, '?') THEN 'PARTIAL' ELSE 'READ' END AS label_status,
        count(DISTINCT CASE WHEN ident IS NOT NULL THEN ident END) AS products, count(ident) AS n_rows, sum(f) AS facings, sum(u) AS visible_units
        FROM (SELECT scan_id, pos, label, rack, lower(brand) || '|' || lower(product_name) || '|' || lower(variant) AS ident, greatest(coalesce(actual_facings, 0), 0) AS f, greatest(coalesce(actual_visible_units, 0), 0) AS u FROM norm WHERE label IS NOT NULL
              UNION ALL SELECT scan_id, pos + 100000000000000000, location, NULL, NULL, 0, 0 FROM plan WHERE ln = 1
              UNION ALL SELECT scan_id, pos + 100000000000000000, 'A-' || substr(location, 3, 1) || '?', NULL, NULL, 0, 0 FROM plan WHERE ln = 6) GROUP BY scan_id, label""",
    "amb": """SELECT p.scan_id, p.label, count(*) AS fits FROM roll p JOIN roll o ON p.scan_id = o.scan_id AND p.label <> o.label AND length(p.label) = length(o.label)
        AND contains(p.label, '?') AND (o.label LIKE replace(p.label, '?', '_') OR p.label LIKE replace(o.label, '?', '_')) GROUP BY p.scan_id, p.label HAVING count(*) >= 2""",
}


def _read_labels(d):
    """Labels read without a product: those of unseen planned rows, some of them partial."""
    off = F.lit(100000000000000000)
    none = F.lit(None).cast("string")
    seen = F.when(F.col("ln") == 1, F.col("location")).otherwise(F.concat(F.lit("A-"), F.substring("location", 3, 1), F.lit("?")))
    return d.plan.where("ln IN (1, 6)").select("scan_id", (F.col("pos") + off).alias("pos"), seen.alias("label"), none.alias("rack_marker"), none.alias("status"))


ROWCOLS = ["scan_id", "pos", "facing_variance", "facing_variance_percent", "facing_compliance", "shelf_unit_variance",
           "shelf_unit_compliance", "visible_unit_shortfall", "value_gap_inr", "coverage_days"]


@query("f2_row_formulas", f"SELECT {', '.join(ROWCOLS)} FROM rowm2", OWN)
def f2(d):
    return P.row_metrics(d.prows).select(ROWCOLS)


@query("f3_min_max_status", "SELECT scan_id, pos, min_max_status FROM rowm", OWN)
def f3(d):
    return P.row_metrics(d.prows).select("scan_id", "pos", "min_max_status")


@query("f1_ratio_functions", """SELECT scan_id, pos, CASE WHEN expected_qty <> 0 THEN CAST(actual_facings AS DOUBLE) / expected_qty END AS safe_ratio,
    round_even(actual_facings / nullif(expected_qty, 0) * 100.0e0, 1) AS pct FROM prows""")
def f1(d):
    from shelfwright.functions import numbers as N
    return d.prows.select("scan_id", "pos", N.ratio(F.col("actual_facings"), F.col("expected_qty")).alias("safe_ratio"),
                          N.percentage(F.col("actual_facings"), F.col("expected_qty")).alias("pct"))


@query("g25_row_checks", """SELECT scan_id, sum(passed) AS passed, sum(applicable) AS applicable, round_even(sum(passed) / sum(applicable) * 100.0e0, 1) AS planogram_compliance
    FROM checks GROUP BY scan_id""", OWN)
def g25(d):
    return P.check_compliance(d.prows)


@query("g26_facing_compliance", """SELECT scan_id, coalesce(sum(actual_facings), 0) AS actual_sum, coalesce(sum(expected_facings) FILTER (actual_facings IS NOT NULL), 0) AS expected_sum,
    round_even(sum(actual_facings) / sum(expected_facings) FILTER (actual_facings IS NOT NULL) * 100.0e0, 1) AS overall_facing_compliance FROM prows GROUP BY scan_id""")
def g26(d):
    return P.facing_compliance_total(d.prows)


def _unplanned(d):
    return d.cv.where("ln = 7")


@query("g27_brand_plan_share", """SELECT *, round_even(actual_share_percent - expected_share_percent, 1) AS share_variance_pp,
    CASE WHEN actual_share_percent + 0.5e0 < expected_share_percent THEN 'UNDER_SHARE' WHEN actual_share_percent > expected_share_percent + 0.5e0 THEN 'OVER_SHARE' ELSE 'OK' END AS status
    FROM (SELECT scan_id, k AS brand, coalesce(e, 0) AS expected_facings, coalesce(a, 0) AS actual_facings,
      round_even(coalesce(e, 0) / nullif(sum(e) OVER (PARTITION BY scan_id), 0) * 100.0e0, 1) AS expected_share_percent,
      round_even(coalesce(a, 0) / nullif(sum(a) OVER (PARTITION BY scan_id), 0) * 100.0e0, 1) AS actual_share_percent
      FROM (SELECT scan_id, k, sum(e) AS e, sum(a) AS a FROM combo GROUP BY scan_id, k) WHERE e IS NOT NULL OR a IS NOT NULL)""", OWN)
def g27(d):
    return P.brand_plan_share(d.prows, _unplanned(d))


@query("g28_group_plan_share", """SELECT scan_id, level, label, coalesce(e, 0) AS expected_facings, a AS actual_facings,
    round_even(coalesce(e, 0) / nullif(sum(e) OVER (PARTITION BY scan_id, level), 0) * 100.0e0, 1) AS expected_share_percent,
    CASE WHEN a IS NOT NULL THEN round_even(a / nullif(sum(a) OVER (PARTITION BY scan_id, level), 0) * 100.0e0, 1) END AS actual_share_percent
    FROM (SELECT scan_id, 'category' AS level, category AS label, sum(e) AS e, sum(CASE WHEN seen THEN a0 END) AS a FROM combo WHERE e IS NOT NULL OR seen GROUP BY scan_id, category
          UNION ALL SELECT scan_id, 'subcategory', sub_category, sum(e), sum(CASE WHEN seen THEN a0 END) FROM combo WHERE e IS NOT NULL OR seen GROUP BY scan_id, sub_category)
    WHERE e IS NOT NULL OR a IS NOT NULL""", OWN)
def g28(d):
    return P.group_plan_share(d.prows, _unplanned(d))


VALUE = """SELECT scan_id, count(mrp_inr) AS priced_sku_count,
    CASE WHEN count(mrp_inr) > 0 THEN coalesce(CAST(sum(actual_visible_units * CAST(mrp_inr AS DECIMAL(18,2))) AS DOUBLE), 0) END AS visible_value_inr,
    CASE WHEN count(mrp_inr) > 0 THEN coalesce(CAST(sum(expected_shelf_units * CAST(mrp_inr AS DECIMAL(18,2))) AS DOUBLE), 0) END AS expected_value_inr,
    CASE WHEN count(mrp_inr) > 0 THEN coalesce(CAST(sum(visible_unit_shortfall * CAST(mrp_inr AS DECIMAL(18,2))) AS DOUBLE), 0) END AS value_gap_inr FROM rowm GROUP BY scan_id"""


@query("g29_inventory_value", VALUE, OWN)
def g29(d):
    return P.inventory_value(d.prows)


@query("v30_presence_only", """SELECT p.scan_id, p.pos, sets_facings, CASE WHEN sets_facings THEN round_even(actual_facings / nullif(expected_qty, 0) * 100.0e0, 1) END AS facing_compliance,
    CASE WHEN NOT sets_facings THEN 'NOT_APPLICABLE' WHEN actual_facings IS NULL OR expected_qty = 0 THEN 'UNAVAILABLE' ELSE 'CALCULATED' END AS status
    FROM prows p JOIN (SELECT r.scan_id, bool_or(r.expected_qty > 1) OR any_value(s.priority = '1-URGENT') AS sets_facings FROM prows r JOIN scans s ON r.scan_id = s.scan_id GROUP BY r.scan_id) t
    ON p.scan_id = t.scan_id""")
def v30(d):
    docs = d.scans.select("scan_id", F.when(F.col("priority") == "1-URGENT", "planogram").otherwise("invoice").alias("document_type"))
    return P.presence_only(d.prows.withColumn("expected_facings", F.col("expected_qty")), docs)


@query("g34_location_rollup", "SELECT * FROM roll", OWN)
def g34(d):
    return LO.label_rollup(d.cv, _read_labels(d))


@query("g35_ambiguous_labels", "SELECT * FROM amb", OWN)
def g35(d):
    return LO.ambiguous_labels(cut_lineage(LO.label_rollup(d.cv, _read_labels(d)).select("scan_id", "label")))


@query("g34_location_metrics", """SELECT b.scan_id, coalesce(r.n, 0) AS location_labels_read, coalesce(r.e, 0) AS empty_locations, coalesce(r.am, 0) AS ambiguous_labels, b.racks_detected,
    b.without + coalesce(r.ar, 0) AS products_without_location, b.prices_read
    FROM (SELECT scan_id, count(*) FILTER (label IS NULL) AS without, count(DISTINCT rack) AS racks_detected, count(*) FILTER (visible_price IS NOT NULL AND visible_price <> 'not visible') AS prices_read FROM norm GROUP BY scan_id) b
    LEFT JOIN (SELECT l.scan_id, count(*) FILTER (a.label IS NULL) AS n, count(*) FILTER (a.label IS NULL AND products = 0) AS e, count(a.label) AS am,
      sum(CASE WHEN a.label IS NOT NULL THEN n_rows ELSE 0 END) AS ar FROM roll l LEFT JOIN amb a ON l.scan_id = a.scan_id AND l.label = a.label GROUP BY l.scan_id) r ON b.scan_id = r.scan_id""", OWN)
def g34b(d):
    return LO.location_metrics(d.cv, _read_labels(d))


@query("v31_annotate_rows", """SELECT r.scan_id, r.pos, CASE WHEN act <> '' AND r.location LIKE replace(act, '?', '_') THEN CASE WHEN contains(act, '?') THEN 'NOT_READABLE' ELSE 'CORRECT' END
    WHEN NOT any_fit THEN 'EXPECTED_NOT_IN_PHOTO' WHEN act = '' OR contains(act, '?') OR NOT full_fit THEN 'NOT_READABLE' ELSE 'WRONG_LOCATION' END AS location_status,
    CASE WHEN mrp_inr IS NULL THEN 'NO_EXPECTED' WHEN vp IS NULL THEN 'NOT_READABLE' WHEN round_even(vp, 2) = round_even(mrp_inr, 2) THEN 'MATCH' ELSE 'MISMATCH' END AS price_status,
    round_even(vp - mrp_inr, 2) AS price_difference
    FROM (SELECT p.*, CASE WHEN p.location_label IS NULL OR a.label IS NOT NULL THEN '' ELSE replace(upper(p.location_label), ' ', '') END AS act,
      TRY_CAST(nullif(regexp_extract(p.visible_price, '[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS vp,
      EXISTS (SELECT 1 FROM roll g WHERE g.scan_id = p.scan_id AND g.label = p.location) AS full_fit,
      EXISTS (SELECT 1 FROM roll g WHERE g.scan_id = p.scan_id AND p.location LIKE replace(g.label, '?', '_') AND NOT EXISTS (SELECT 1 FROM amb b WHERE b.scan_id = g.scan_id AND b.label = g.label)) AS any_fit
      FROM prows p LEFT JOIN amb a ON p.scan_id = a.scan_id AND a.label = replace(upper(p.location_label), ' ', '') WHERE attached) r""", OWN)
def v31(d):
    return LO.annotate_rows(d.prows, LO.label_rollup(d.cv, _read_labels(d)))


@query("f6_visible_price", "SELECT scan_id, pos, TRY_CAST(nullif(regexp_extract(visible_price, '[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS price FROM cv")
def f6(d):
    return d.cv.select("scan_id", "pos", L.visible_price(F.col("visible_price")).alias("price"))


@query("f5_price_in_text", """SELECT scan_id, pos, CASE WHEN m BETWEEN 5 AND 50000 THEN m WHEN b BETWEEN 5 AND 50000 THEN b END AS price FROM (SELECT scan_id, pos,
    TRY_CAST(nullif(regexp_extract(pack_text, '(?i)(?:mrp|rs\\.?|inr|price)\\s*[:\\-]?\\s*(\\d{1,6}(?:\\.\\d{1,2})?)', 1), '') AS DOUBLE) AS m,
    TRY_CAST(nullif(regexp_extract(pack_text, '\\b(\\d{2,5})\\b', 1), '') AS DOUBLE) AS b FROM fac)""")
def f5(d):
    return d.fac.select("scan_id", "pos", L.price_in_text(F.col("pack_text")).alias("price"))


@query("f7_label_match", """SELECT c.scan_id, c.pos, replace(upper(coalesce(c.location_label, '')), ' ', '') AS label,
    coalesce(p.location LIKE replace(replace(upper(c.location_label), ' ', ''), '?', '_'), false) AS fits FROM cv c JOIN plan p ON c.scan_id = p.scan_id AND c.pos = p.pos""")
def f7(d):
    j = d.cv.select("scan_id", "pos", "location_label").join(d.plan.select("scan_id", "pos", "location"), ["scan_id", "pos"])
    n = L.normalize_label(F.col("location_label"))
    return j.select("scan_id", "pos", n.alias("label"), L.fits(n, L.normalize_label(F.col("location"))).alias("fits"))


@query("f8_location_and_price_status", """SELECT scan_id, pos, CASE WHEN act LIKE replace(act, '?', '_') AND location LIKE replace(act, '?', '_') AND act <> '' THEN CASE WHEN contains(act, '?') THEN 'NOT_READABLE' ELSE 'CORRECT' END
    WHEN act = '' OR contains(act, '?') THEN 'NOT_READABLE' ELSE 'WRONG_LOCATION' END AS location_status,
    CASE WHEN mrp_inr IS NULL THEN 'NO_EXPECTED' WHEN vp IS NULL THEN 'NOT_READABLE' WHEN round_even(vp, 2) = round_even(mrp_inr, 2) THEN 'MATCH' ELSE 'MISMATCH' END AS price_status
    FROM (SELECT *, replace(upper(coalesce(location_label, '')), ' ', '') AS act, TRY_CAST(nullif(regexp_extract(visible_price, '[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS vp FROM prows WHERE attached)""")
def f8(d):
    return d.prows.where("attached").select(
        "scan_id", "pos", L.location_status(F.col("location"), F.col("location_label"), F.array("location"), F.array().cast("array<string>")).alias("location_status"),
        L.price_status(F.col("mrp_inr"), F.col("visible_price")).alias("price_status"))


@query("v24_cap_units", """SELECT scan_id, pos, actual_visible_units AS raw_visible_units, CASE WHEN actual_facings > 0 AND actual_visible_units > actual_facings THEN actual_facings ELSE actual_visible_units END AS actual_visible_units,
    coalesce(actual_facings > 0 AND actual_visible_units > actual_facings, false) AS capped FROM cv""")
def v24(d):
    return C.cap_units(d.cv).select("scan_id", "pos", "raw_visible_units", "actual_visible_units", "capped")


CHECK = {
    "summ": """SELECT scan_id, CASE WHEN scan_id % 11 = 0 THEN NULL ELSE sum(actual_facings) + scan_id % 4 END AS total_facings,
        sum(actual_visible_units) + CASE WHEN scan_id % 6 = 0 THEN 20 ELSE 0 END AS total_units FROM cv GROUP BY scan_id""",
    "agg_c": """SELECT s.scan_id, s.total_facings, s.total_units, count(c.actual_facings) AS nf, count(c.actual_visible_units) AS nu,
        CASE WHEN count(c.actual_facings) > 0 THEN sum(greatest(c.actual_facings, 0)) END AS f, CASE WHEN count(c.actual_visible_units) > 0 THEN sum(greatest(c.actual_visible_units, 0)) END AS u
        FROM summ s JOIN cv c ON s.scan_id = c.scan_id GROUP BY ALL""",
    "chk": """SELECT *, CASE WHEN f IS NULL AND total_facings IS NULL THEN 'UNAVAILABLE' WHEN f IS NULL OR total_facings IS NULL THEN 'COUNT_MISMATCH' WHEN f = total_facings THEN 'VERIFIED'
          WHEN abs(f - total_facings) <= greatest(2, ceil(0.03e0 * greatest(f, total_facings))) THEN 'APPROXIMATE' ELSE 'COUNT_MISMATCH' END AS fs,
        CASE WHEN u IS NULL AND total_units IS NULL THEN 'UNAVAILABLE' WHEN u IS NULL OR total_units IS NULL THEN 'COUNT_MISMATCH' WHEN u = total_units THEN 'VERIFIED'
          WHEN abs(u - total_units) <= greatest(2, ceil(0.03e0 * greatest(u, total_units))) THEN 'APPROXIMATE' ELSE 'COUNT_MISMATCH' END AS us FROM agg_c""",
    "chk2": """SELECT scan_id, f AS facings_sum, fs AS facings_status, CASE WHEN fs IN ('VERIFIED', 'APPROXIMATE') THEN f END AS facings_verified,
        u AS units_sum, us AS units_status, CASE WHEN us IN ('VERIFIED', 'APPROXIMATE') THEN u END AS units_verified,
        CASE WHEN fs = 'COUNT_MISMATCH' OR us = 'COUNT_MISMATCH' THEN 'COUNT_MISMATCH' WHEN fs = 'APPROXIMATE' OR us = 'APPROXIMATE' THEN 'APPROXIMATE' ELSE 'VERIFIED' END AS scan_status,
        NOT (fs = 'COUNT_MISMATCH' OR us = 'COUNT_MISMATCH') AS scan_complete FROM chk""",
}


def _verified(d):
    s = d.cv.groupBy("scan_id").agg(F.sum("actual_facings").alias("f"), F.sum("actual_visible_units").alias("u")).select(
        "scan_id", F.when(F.col("scan_id") % 11 != 0, F.col("f") + F.col("scan_id") % 4).alias("total_facings"),
        (F.col("u") + F.when(F.col("scan_id") % 6 == 0, 20).otherwise(0)).alias("total_units"))
    return C.verify_counts(d.cv, s)


@query("g32_count_verification", "SELECT * FROM chk2", CHECK)
def g32(d):
    return _verified(d)


@query("g33_withhold_incomplete", """SELECT c.scan_id, CASE WHEN scan_complete THEN facings_sum END AS facings_sum, CASE WHEN scan_complete THEN pc END AS planogram_compliance,
    CASE WHEN NOT scan_complete THEN 'COUNT_MISMATCH' WHEN facings_sum IS NULL THEN 'UNAVAILABLE' ELSE 'CALCULATED' END AS facings_sum_status,
    CASE WHEN NOT scan_complete THEN 'COUNT_MISMATCH' WHEN pc IS NULL THEN 'UNAVAILABLE' ELSE 'CALCULATED' END AS planogram_compliance_status
    FROM chk2 c LEFT JOIN (SELECT scan_id, round_even(sum(passed) / sum(applicable) * 100.0e0, 1) AS pc FROM checks GROUP BY scan_id) k ON c.scan_id = k.scan_id""", {**OWN, **CHECK})
def g33(d):
    m = _verified(d).join(P.check_compliance(d.prows).select("scan_id", "planogram_compliance"), "scan_id", "left")
    return C.withhold_incomplete(m, ["facings_sum", "planogram_compliance"])


@query("v20_brand_by_neighbour", """SELECT scan_id, pos, CASE WHEN brand = 'Brand#1' AND EXISTS (SELECT 1 FROM fac g WHERE g.scan_id = f.scan_id AND g.brand = 'Brand#2') THEN 'Brand 2' ELSE brand END AS brand,
    CASE WHEN brand = 'Brand#1' AND EXISTS (SELECT 1 FROM fac g WHERE g.scan_id = f.scan_id AND g.brand = 'Brand#2') THEN replace(pack_text, 'Brand#1 ', 'Brand 2 ') ELSE pack_text END AS pack_text FROM fac f""")
def v20(d):
    return C.fix_brand_by_neighbour(d.fac, "brand#1", "brand#2", "Brand 2").select("scan_id", "pos", "brand", "pack_text")


@query("v21_canonical_brand", """SELECT scan_id, pos, CASE WHEN first OR second THEN 'Lay''s' ELSE brand END AS brand, CASE WHEN second OR (first AND st IN ('', 'unknown')) THEN 'IDENTIFIED' ELSE brand_status END AS brand_status
    FROM (SELECT *, lower(brand_status) AS st, lower(brand) IN ('louis', 'lay5') AND (flav OR chips) AS first, flav AND lower(brand) = 'unknown' AS second
      FROM (SELECT scan_id, pos, brand, brand_status, variant = 'Tangy  Tomato' AS flav, product_name = 'potato chips' AS chips
        FROM (SELECT scan_id, pos, CASE l_partkey % 4 WHEN 0 THEN 'LOUIS' WHEN 1 THEN 'Lay5' WHEN 2 THEN 'Unknown' ELSE p_brand END AS brand, CASE WHEN ln % 2 = 0 THEN 'unknown' ELSE 'READ' END AS brand_status,
          CASE WHEN l_suppkey % 3 = 0 THEN 'Tangy  Tomato' ELSE p_type END AS variant, CASE WHEN l_suppkey % 3 = 1 THEN 'potato chips' ELSE p_name END AS product_name FROM base)))""")
def v21(d):
    k, s = F.col("l_partkey") % 4, F.col("l_suppkey") % 3
    rows = d.base.select(
        "scan_id", "pos", F.when(k == 0, "LOUIS").when(k == 1, "Lay5").when(k == 2, "Unknown").otherwise(F.col("p_brand")).alias("brand"),
        F.when(F.col("ln") % 2 == 0, "unknown").otherwise("READ").alias("brand_status"),
        F.when(s == 0, "Tangy  Tomato").otherwise(F.col("p_type")).alias("variant"), F.when(s == 1, "potato chips").otherwise(F.col("p_name")).alias("product_name"))
    return C.canonical_chip_brand(rows).select("scan_id", "pos", "brand", "brand_status")


@query("v29_merge_states", """SELECT c.scan_id, 'osa' AS metric_id, c.v AS value, CASE WHEN x.s IS NOT NULL AND c.v IS NULL AND x.s NOT IN ('available', 'calculated') THEN x.s
    WHEN x.s IS NOT NULL AND c.v IS NOT NULL THEN CASE WHEN x.s = 'calculated' THEN 'available' ELSE c.s END ELSE c.s END AS state, x.l AS label
    FROM (SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN NULL ELSE amount END AS v, CASE WHEN scan_id % 3 = 0 THEN 'not_configured' ELSE 'estimated' END AS s FROM scans) c
    LEFT JOIN (SELECT scan_id, CASE status WHEN 'F' THEN 'calculated' WHEN 'O' THEN 'insufficient_evidence' END AS s, priority AS l FROM scans WHERE scan_id % 5 <> 0) x ON c.scan_id = x.scan_id""")
def v29(d):
    m3 = F.col("scan_id") % 3 == 0
    computed = d.scans.select("scan_id", F.lit("osa").alias("metric_id"), F.when(~m3, F.col("amount")).alias("value"),
                              F.when(m3, "not_configured").otherwise("estimated").alias("state"), F.lit("").alias("label"))
    ext = d.scans.where("scan_id % 5 <> 0").select("scan_id", F.lit("osa").alias("metric_id"), F.when(F.col("status") == "F", "calculated").when(
        F.col("status") == "O", "insufficient_evidence").otherwise("guess").alias("state"), F.col("priority").alias("label"))
    return C.merge_states(computed, ext)


@query("g41_merge_photos", """SELECT p.scan_id, photos, total_facings, CASE q WHEN 2 THEN 'POOR' WHEN 1 THEN 'LIMITED' WHEN 0 THEN 'GOOD' END AS quality, coalesce(labels, 0) AS labels FROM (
    SELECT scan_id // 8 AS scan_id, count(*) AS photos, CASE WHEN count(t) = count(*) THEN sum(t) END AS total_facings, max(q) AS q
    FROM (SELECT s.scan_id, CASE WHEN s.scan_id % 50 = 0 THEN NULL ELSE f END AS t, CASE s.status WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS q FROM scans s JOIN (SELECT scan_id, sum(qty) AS f FROM base GROUP BY scan_id) b ON s.scan_id = b.scan_id) GROUP BY 1) p
    LEFT JOIN (SELECT scan_id // 8 AS scan_id, count(DISTINCT lower(trim(location_label))) AS labels FROM cv WHERE location_label IS NOT NULL GROUP BY 1) l ON p.scan_id = l.scan_id""")
def g41(d):
    totals = d.base.groupBy("scan_id").agg(F.sum("qty").alias("f"))
    shelf = F.floor(F.col("scan_id") / 8)
    photos = d.scans.join(totals, "scan_id").select(
        shelf.alias("scan_id"), (F.col("scan_id") % 8).alias("photo"), F.when(F.col("scan_id") % 50 != 0, F.col("f")).alias("total_facings"),
        F.when(F.col("status") == "F", "good").when(F.col("status") == "O", "limited").otherwise("poor").alias("quality"))
    labels = d.cv.where("location_label IS NOT NULL").select(shelf.alias("scan_id"), (F.col("scan_id") % 8).alias("photo"), F.col("location_label").alias("label"))
    return C.merge_photos(photos, labels)


def _photo_rows(d):
    shelf = F.floor(F.col("scan_id") / 8)
    photo = (F.col("scan_id") % 8).alias("photo")
    return d.scans.select(shelf.alias("scan_id"), photo), d.cv.select(shelf.alias("scan_id"), photo, "pos", "brand", "product_name", "variant", "category", "actual_facings", "location_label")


@query("g41_merged_lists", """SELECT scan_id // 8 AS scan_id, 'products' AS list, scan_id % 8 AS photo, brand || ' ' || product_name AS entry FROM cv
    UNION ALL SELECT scan_id // 8, 'location_labels', min(scan_id % 8), arg_min(location_label, struct_pack(p := scan_id % 8, l := location_label)) FROM cv WHERE location_label IS NOT NULL GROUP BY scan_id // 8, lower(trim(location_label))""")
def g41b(d):
    _, rows = _photo_rows(d)
    return C.merged_lists(rows.select("scan_id", "photo", F.concat_ws(" ", "brand", "product_name").alias("entry")),
                          rows.where("location_label IS NOT NULL").select("scan_id", "photo", F.col("location_label").alias("label")))


@query("g41_merged_summary", """SELECT p.scan_id, photo_count, facings_per_photo, merged_facings, coalesce(products_detected, 0) AS products_detected, coalesce(brands_detected, 0) AS brands_detected, coalesce(categories_detected, 0) AS categories_detected FROM (
    SELECT scan_id // 8 AS scan_id, count(*) AS photo_count, string_agg(CAST(n AS VARCHAR), ',' ORDER BY scan_id) AS facings_per_photo, sum(n) AS merged_facings FROM (SELECT s.scan_id, coalesce(sum(greatest(0, actual_facings)), 0) AS n FROM scans s LEFT JOIN cv ON s.scan_id = cv.scan_id GROUP BY s.scan_id) GROUP BY 1) p
    LEFT JOIN (SELECT scan_id // 8 AS scan_id, count(DISTINCT lower(brand || '|' || product_name || '|' || variant)) AS products_detected, count(DISTINCT lower(brand)) AS brands_detected, count(DISTINCT lower(category)) AS categories_detected FROM cv GROUP BY 1) l ON p.scan_id = l.scan_id""")
def g41c(d):
    photos, rows = _photo_rows(d)
    return C.merged_summary(photos, rows)


EVID = """SELECT scan_id, count(*) FILTER (s = 'v') AS verified_shelf_absence_count, count(*) FILTER (s = 'c') AS confirmed_inventory_stockout_count, count(*) FILTER (s = 'g') AS suspected_shelf_gap_count,
    count(*) FILTER (s = 'n') AS not_observed_count, count(*) FILTER (s IN ('v', 'c')) AS confirmed_oos_count
    FROM (SELECT scan_id, CASE WHEN ln = 6 AND actual_qty <= 0 THEN 'c' WHEN expected_qty % 7 = 0 THEN 'n' WHEN issue_type IN ('missing', 'wrong_product', 'wrong_location') AND ln <> 1 THEN 'v'
      WHEN actual_qty <= 0 AND ln = 1 THEN 'g' ELSE 'n' END AS s FROM lines WHERE expected_qty IS NOT NULL) GROUP BY scan_id"""


@query("g36_stockout_evidence", EVID)
def g36(d):
    t = F.lit(True)
    rows = d.lines.where("expected_qty IS NOT NULL").select("scan_id", MO.evidence_state(
        F.col("actual_qty"), t, F.coalesce(F.col("issue_type").isin(MO.ABSENT), F.lit(False)), F.col("ln") != 1,
        F.col("expected_qty") % 7 != 0, F.col("ln") == 6).alias("state"))
    return MO.evidence_counts(rows)


IMPACT = """SELECT scan_id, oos AS oos_sku_count, risk AS at_risk_sku_count, v AS daily_inr, v * 7 AS weekly_inr, v * 30 AS monthly_inr,
    CASE WHEN priced THEN 2 ELSE 1 END AS level, CASE WHEN priced THEN 'estimated' ELSE 'not_estimated' END AS estimate_status
    FROM (SELECT *, CASE WHEN NOT priced OR (dd <= 0 AND oos = 0 AND risk = 0) THEN 0 ELSE dd END AS v FROM (SELECT scan_id, count(*) FILTER (oos) AS oos, count(*) FILTER (risk) AS risk,
      CAST(round_even(CAST(sum(CAST(coalesce(oc, 0) + coalesce(rc, 0) AS DECIMAL(24,6))) AS DOUBLE), 0) AS BIGINT) AS dd, bool_or(priced) AS priced FROM {t} GROUP BY scan_id))"""
MONEY = {
    "imp_l": """SELECT l.scan_id, l.oos, CASE WHEN l.oos AND priced THEN v * p END AS oc, l.risk, CASE WHEN l.risk AND priced THEN v * p * (gap / greatest(exp, 1)) END AS rc, priced FROM (
        SELECT l.scan_id, coalesce(issue_type IN ('missing', 'wrong_product', 'wrong_location'), false) AS oos, coalesce(nullif(expected_qty, 0), 1) AS exp,
        greatest(0, coalesce(nullif(expected_qty, 0), 1) - actual_qty) AS gap, coalesce(issue_type = 'qty_mismatch' AND greatest(0, coalesce(nullif(expected_qty, 0), 1) - actual_qty) > 0, false) AS risk,
        coalesce(nullif(k.m, 0), 75.0e0) AS p, coalesce(nullif(k.s, 0), 4.0e0) AS v, coalesce(k.m, 0) <> 0 OR coalesce(k.s, 0) <> 0 AS priced
        FROM lines l LEFT JOIN (SELECT scan_id, lower(brand) || '|' || lower(product_name) AS key, arg_min(struct_pack(x := mrp_inr), pos).x AS m, arg_min(struct_pack(x := avg_daily_sales), pos).x AS s FROM plan GROUP BY 1, 2) k
        ON l.scan_id = k.scan_id AND lower(expected_brand) || '|' || lower(expected_product) = k.key WHERE coalesce(issue_type, '') <> 'correct') l""",
    "imp_p": """SELECT scan_id, oos, CASE WHEN oos AND priced THEN v * p END AS oc, short OR low AS risk, CASE WHEN priced AND short THEN v * p * (gap / exp) WHEN priced AND low THEN p * (2 - found) END AS rc, priced FROM (
        SELECT *, found <= 0 AS oos, found > 0 AND gap > 0 AS short, found > 0 AND gap = 0 AND found < 2 AS low FROM (SELECT *, greatest(0, exp - found) AS gap FROM (
        SELECT p.scan_id, greatest(1, p.expected_qty) AS exp, coalesce(i.q, 0) AS found, coalesce(nullif(mrp_inr, 0), 75.0e0) AS p, coalesce(nullif(avg_daily_sales, 0), 4.0e0) AS v,
        coalesce(mrp_inr, 0) <> 0 OR coalesce(avg_daily_sales, 0) <> 0 AS priced
        FROM plan p LEFT JOIN (SELECT scan_id, brand, product_name, variant, arg_min(quantity, pos) AS q FROM inv WHERE counted_in_totals GROUP BY ALL) i
        ON p.scan_id = i.scan_id AND p.brand = i.brand AND p.product_name = i.product_name AND p.variant = i.variant)))""",
    "imp_i": """SELECT scan_id, quantity <= 0 AS oos, CASE WHEN quantity <= 0 THEN 300.0e0 END AS oc, quantity > 0 AND quantity <= 2 AS risk, CASE WHEN quantity > 0 AND quantity <= 2 THEN (2 - quantity) * 4.0e0 * 75.0e0 * 0.35e0 END AS rc, false AS priced FROM inv WHERE counted_in_totals""",
}


@query("g37_lost_sales_lines", IMPACT.format(t="imp_l"), MONEY)
def g37(d):
    return MO.impact_from_lines(d.lines, d.plan)


@query("g37_lost_sales_plan", IMPACT.format(t="imp_p"), MONEY)
def g37b(d):
    return MO.impact_from_plan(d.plan, d.inv)


@query("g37_lost_sales_inventory", IMPACT.format(t="imp_i"), MONEY)
def g37c(d):
    return MO.impact_from_inventory(d.inv)


@query("g38_enriched_impact", f"""SELECT i.scan_id, i.daily_inr, CASE WHEN pr THEN greatest(level, 2) ELSE level END AS level, CASE WHEN pr AND estimate_status = 'not_estimated' THEN 'estimated' ELSE estimate_status END AS estimate_status,
    CASE WHEN pr THEN visible_value_inr END AS visible_value_inr, CASE WHEN pr THEN value_gap_inr END AS value_gap_inr, CASE WHEN pr THEN 'priced' ELSE 'indicative' END AS confidence
    FROM (SELECT i.*, v.*, coalesce(priced_sku_count, 0) > 0 AS pr FROM ({IMPACT.format(t='imp_i')}) i LEFT JOIN ({VALUE}) v ON i.scan_id = v.scan_id) i""", {**OWN, **MONEY})
def g38(d):
    return MO.enrich_with_value(MO.impact_from_inventory(d.inv), P.inventory_value(d.prows))


@query("g63_value_availability", """SELECT scan_id, round_even(CAST(sum(CASE WHEN coalesce(actual_facings, 0) > 0 THEN w ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(w) AS DOUBLE), 0), 4) AS value_availability,
    round_even(CAST(sum(CASE WHEN coalesce(actual_facings, 0) > 0 THEN 0 ELSE w END) AS DOUBLE), 2) AS gross_loss_inr
    FROM (SELECT *, CAST(avg_daily_sales * mrp_inr AS DECIMAL(24,6)) AS w FROM prows) WHERE w IS NOT NULL GROUP BY scan_id""")
def g63(d):
    return MO.value_weighted_availability(d.prows, "scan_id")


@query("g63_substitution_loss", """SELECT d.scan_id, round_even(CAST(sum(CAST(d.units * d.price AS DECIMAL(24,6))) AS DOUBLE), 2) AS gross_exposure,
    round_even(CAST(sum(CAST(d.units * d.price AS DECIMAL(24,6)) - coalesce(s.r, 0)) AS DOUBLE), 2) AS net_revenue, round_even(CAST(sum(CAST(d.units * d.con AS DECIMAL(24,6)) - coalesce(s.c, 0)) AS DOUBLE), 2) AS net_contribution
    FROM (SELECT scan_id, pos, category, avg_daily_sales AS units, mrp_inr AS price, mrp_inr * 0.2e0 AS con FROM prows WHERE NOT attached AND avg_daily_sales IS NOT NULL AND mrp_inr IS NOT NULL) d
    LEFT JOIN (SELECT scan_id, category, sum(CAST(0.5e0 * mrp_inr AS DECIMAL(24,6))) AS r, sum(CAST(0.5e0 * (mrp_inr * 0.2e0) AS DECIMAL(24,6))) AS c FROM prows WHERE attached AND mrp_inr IS NOT NULL GROUP BY ALL) s
    ON d.scan_id = s.scan_id AND d.category = s.category GROUP BY d.scan_id""")
def g63b(d):
    dem = d.prows.where("NOT attached AND avg_daily_sales IS NOT NULL AND mrp_inr IS NOT NULL").select(
        "scan_id", F.col("category").alias("item"), F.col("avg_daily_sales").alias("units"), F.col("mrp_inr").alias("price"), (F.col("mrp_inr") * 0.2).alias("contribution"))
    sub = d.prows.where("attached AND mrp_inr IS NOT NULL").select(
        "scan_id", F.col("category").alias("item"), F.lit(0.5).alias("units"), F.col("mrp_inr").alias("price"), (F.col("mrp_inr") * 0.2).alias("contribution"))
    return MO.substitution_adjusted(dem, sub)


@query("g62_presence_bounds", """SELECT scan_id, round_even(count(*) FILTER (s = 'p') / count(*), 4) AS lower, round_even(count(*) FILTER (s <> 'u') / count(*), 4) AS coverage, round_even(count(*) FILTER (s <> 'a') / count(*), 4) AS upper
    FROM (SELECT scan_id, CASE match_status WHEN 'NOT_FOUND' THEN 'a' WHEN 'UNVERIFIABLE' THEN 'u' ELSE 'p' END AS s FROM prows) GROUP BY scan_id""")
def g62(d):
    st = F.when(F.col("match_status") == "NOT_FOUND", "absent").when(F.col("match_status") == "UNVERIFIABLE", "unverifiable").otherwise("present")
    return MO.presence_bounds(d.prows.select("scan_id", st.alias("state")))
