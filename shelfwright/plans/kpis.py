"""Queries: audit KPIs, role dashboards, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright.operators import kpi as Q
from shelfwright.operators import money as MO
from shelfwright.plans.registry import query

CALC = """SELECT scan_id, kpi_id, CASE WHEN e > 0 AND a > 0 THEN round_even(p / a * 100.0e0, 4) END AS value,
    CASE WHEN e <= 0 THEN 'not_applicable' WHEN a <= 0 THEN 'not_assessable' WHEN a >= e THEN 'complete' ELSE 'partial' END AS status,
    CASE WHEN a <= 0 THEN 0 ELSE p END AS numerator, CASE WHEN a <= 0 THEN 0 ELSE a END AS denominator,
    round_even(a / e * 100.0e0, 4) AS coverage_percent, greatest(0, e - a) AS excluded_count
    FROM (SELECT scan_id, kpi_id, count(*) FILTER (state = 'pass') AS p, count(*) FILTER (state <> 'not_assessable') AS a, count(*) AS e
          FROM {units} GROUP BY scan_id, kpi_id)"""
OWN = {
    "look": """SELECT scan_id, lower(brand) || '|' || lower(product_name) AS key,
        arg_max(CASE WHEN quantity = 0 THEN facings ELSE quantity END, pos) AS inv_qty,
        arg_max(CASE WHEN facings = 0 THEN quantity ELSE facings END, pos) AS inv_facings FROM inv GROUP BY 1, 2""",
    "listed": """SELECT p.*, k.inv_qty, k.inv_facings FROM plan p LEFT JOIN look k
        ON p.scan_id = k.scan_id AND lower(p.brand) || '|' || lower(p.product_name) = k.key""",
    "osa_u": """SELECT p.scan_id, 'osa' AS kpi_id, CASE WHEN l.issue_type = 'missing' THEN 'fail'
        WHEN l.issue_type IN ('wrong_product', 'wrong_category', 'wrong_location') THEN CASE WHEN coalesce(inv_qty, 0) > 0 THEN 'pass' ELSE 'fail' END
        WHEN coalesce(inv_qty, 0) > 0 THEN 'pass' WHEN l.scan_id IS NULL AND inv_qty IS NULL THEN 'not_assessable' ELSE 'fail' END AS state
        FROM listed p LEFT JOIN (SELECT * FROM lines WHERE coalesce(issue_type, '') <> 'unexpected') l ON p.scan_id = l.scan_id AND p.pos = l.pos""",
    "pos_u": """SELECT scan_id, 'planogram_compliance' AS kpi_id, CASE WHEN issue_type IS NULL THEN 'not_assessable' WHEN issue_type = 'correct' THEN 'pass' ELSE 'fail' END AS state FROM lines""",
    "ass_u": """SELECT scan_id, 'assortment_compliance' AS kpi_id, CASE WHEN coalesce(inv_qty, 0) > 0 THEN 'pass' ELSE 'fail' END AS state FROM listed WHERE ln <> 2""",
    "msl_u": """SELECT scan_id, 'msl_compliance' AS kpi_id, CASE WHEN coalesce(inv_qty, 0) > 0 THEN 'pass' ELSE 'fail' END AS state FROM listed WHERE sku <> ''""",
    "plan_price": """SELECT scan_id, lower(brand) || '|' || lower(product_name) AS key, arg_max(struct_pack(p := mrp_inr), pos).p AS expected FROM plan GROUP BY 1, 2""",
    "price_l": """SELECT f.scan_id, f.pos, f.brand, f.product_name, expected AS expected_price_inr, CASE WHEN f.price BETWEEN 5 AND 50000 THEN f.price END AS detected_price_inr,
        round_even(CASE WHEN f.price BETWEEN 5 AND 50000 THEN f.price END - expected, 2) AS variance_inr
        FROM (SELECT scan_id, pos, CASE WHEN ln = 7 THEN 'Unknown' ELSE p_brand END AS brand, p_name AS product_name,
              CASE WHEN qty % 4 >= 2 THEN CAST(CAST(floor(p_retailprice) AS INT) + ln - 3 AS DOUBLE) WHEN qty % 4 = 1 THEN CAST(l_partkey % 100 AS DOUBLE) END AS price FROM base) f
        JOIN plan_price k ON f.scan_id = k.scan_id AND lower(f.brand) || '|' || lower(f.product_name) = k.key WHERE expected IS NOT NULL""",
    "price_s": """SELECT *, CASE WHEN detected_price_inr IS NULL THEN 'not_observable' WHEN abs(variance_inr) <= 5 THEN 'compliant' ELSE 'non_compliant' END AS status FROM price_l""",
    "price_u": """SELECT scan_id, 'price_compliance' AS kpi_id, CASE status WHEN 'compliant' THEN 'pass' WHEN 'non_compliant' THEN 'fail' ELSE 'not_assessable' END AS state FROM price_s""",
    "promo": """SELECT p.scan_id, p.pos AS promotion_id, p.category, s.scan_ts, p.expected_facings, p.ln FROM plan p JOIN scans s ON p.scan_id = s.scan_id
        WHERE p.expected_facings % 2 = 0 AND s.scan_ts >= TIMESTAMP '1996-01-01' AND s.scan_ts < TIMESTAMP '2000-07-01'""",
    "promo_u": """SELECT p.scan_id, 'promotional_compliance' AS kpi_id, CASE WHEN c.pos IS NULL THEN 'not_assessable' WHEN c.promotion_text IS NOT NULL THEN 'pass' ELSE 'fail' END AS state
        FROM promo p LEFT JOIN cv c ON p.scan_id = c.scan_id AND p.promotion_id = c.pos""",
    "loc_u": """SELECT scan_id, 'location_accuracy' AS kpi_id, CASE WHEN issue_type IN ('wrong_product', 'wrong_location') THEN 'fail'
        WHEN issue_type IN ('correct', 'qty_mismatch') THEN 'pass' ELSE 'not_assessable' END AS state FROM lines WHERE actual_qty > 0""",
    "loc_k": """SELECT scan_id, kpi_id, round_even(p / e * 100.0e0, 4) AS value, 'complete' AS status, p AS numerator, e AS denominator, 100.0e0 AS coverage_percent, 0 AS excluded_count
        FROM (SELECT scan_id, kpi_id, count(*) FILTER (state = 'pass') AS p, count(*) AS e FROM loc_u GROUP BY scan_id, kpi_id)""",
    "fac_k": """SELECT scan_id, 'facing_count' AS kpi_id, CAST(sum(coalesce(inv_facings, 0)) AS DOUBLE) AS value, CASE WHEN count(inv_facings) < count(*) THEN 'partial' ELSE 'complete' END AS status,
        sum(coalesce(inv_facings, 0)) AS numerator, nullif(sum(expected_facings), 0) AS denominator, round_even(count(inv_facings) / count(*) * 100.0e0, 4) AS coverage_percent,
        count(*) - count(inv_facings) AS excluded_count FROM listed GROUP BY scan_id""",
    "sos_k": """SELECT scan_id, 'share_of_shelf' AS kpi_id, round_even(sum(CASE WHEN brand = 'Brand#1' THEN x2 - x1 ELSE 0 END) / sum(x2 - x1) * 100.0e0, 4) AS value, 'complete' AS status,
        sum(CASE WHEN brand = 'Brand#1' THEN x2 - x1 ELSE 0 END) AS numerator, sum(x2 - x1) AS denominator, 100.0e0 AS coverage_percent, 0 AS excluded_count FROM fac GROUP BY scan_id""",
    "units": "SELECT * FROM osa_u UNION ALL SELECT * FROM pos_u UNION ALL SELECT * FROM ass_u UNION ALL SELECT * FROM msl_u UNION ALL SELECT * FROM price_u UNION ALL SELECT * FROM promo_u",
    "all_k": "SELECT * FROM (" + CALC.format(units="units") + ") UNION ALL SELECT * FROM loc_k UNION ALL SELECT * FROM fac_k UNION ALL SELECT * FROM sos_k",
    "roles": "SELECT * FROM (VALUES " + ", ".join(
        f"('{r}', {i + 1}, '{k}')" for r, ks in Q.ROLE_KPIS.items() for i, k in enumerate(ks)) + ") t(role_id, slot, kpi_id)",
}


def _classified(d):
    """Facings with a readable price in their pack text, by order."""
    qty = F.col("qty")
    text = F.when(qty % 4 >= 2, F.concat(F.lit("MRP: "), (F.col("p_retailprice").cast("int") + F.col("ln") - 3).cast("string"))).when(
        qty % 4 == 1, F.concat(F.col("p_name"), F.lit(" "), (F.col("l_partkey") % 100).cast("string"), F.lit(" rs "),
                               (F.col("l_partkey") % 100).cast("string")))
    return d.base.select("scan_id", "pos", F.when(F.col("ln") == 7, "Unknown").otherwise(F.col("p_brand")).alias("brand"),
                         F.col("p_name").alias("product_name"), text.alias("pack_text"))


def _price_lines(d):
    return MO.price_lines(_classified(d), d.plan)


def _promos(d):
    ts = F.col("scan_ts")
    active = d.plan.where("expected_facings % 2 = 0").join(d.scans, "scan_id").where(
        (ts >= F.lit("1996-01-01").cast("timestamp_ntz")) & (ts < F.lit("2000-07-01").cast("timestamp_ntz")))
    promos = active.select("scan_id", F.col("pos").alias("promotion_id"), F.lit(None).cast("string").alias("status"))
    results = d.cv.select("scan_id", F.col("pos").alias("promotion_id"),
                          F.when(F.col("promotion_text").isNotNull(), "pass").otherwise("fail").alias("status"))
    return Q.promotion_units(promos, results)


def _units(d):
    parts = [
        Q.osa_units(d.plan, d.inv, d.lines), Q.position_units(d.lines),
        Q.presence_units(d.plan.where("ln <> 2"), d.inv, "assortment_compliance"),
        Q.presence_units(d.plan.where("sku <> ''"), d.inv, "msl_compliance"),
        Q.price_units(_price_lines(d)), _promos(d),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _all_kpis(d):
    cols = ["scan_id", "kpi_id", "value", "status", "numerator", "denominator", "coverage_percent", "excluded_count"]
    out = Q.kpi_from_units(_units(d)).select(cols)
    for k in (Q.location_kpi(d.lines), Q.facing_count(d.plan, d.inv), Q.linear_share(d.fac, "Brand#1")):
        out = out.unionByName(k.select(cols))
    return out


@query("g13_kpi_from_units", CALC.format(units="units"), OWN)
def g13(d):
    return Q.kpi_from_units(_units(d))


@query("g14_osa", CALC.format(units="osa_u"), OWN)
def g14(d):
    return Q.kpi_from_units(Q.osa_units(d.plan, d.inv, d.lines))


@query("j13_inventory_lookup", "SELECT scan_id, pos, inv_qty, inv_facings FROM listed", OWN)
def j13(d):
    return Q.with_inventory(d.plan, d.inv).select("scan_id", "pos", "inv_qty", "inv_facings")


@query("g15_planogram_position", CALC.format(units="pos_u"), OWN)
def g15(d):
    return Q.kpi_from_units(Q.position_units(d.lines))


@query("g16_assortment", CALC.format(units="ass_u"), OWN)
def g16(d):
    return Q.kpi_from_units(Q.presence_units(d.plan.where("ln <> 2"), d.inv, "assortment_compliance"))


@query("g17_must_stock", CALC.format(units="msl_u"), OWN)
def g17(d):
    return Q.kpi_from_units(Q.presence_units(d.plan.where("sku <> ''"), d.inv, "msl_compliance"))


@query("j10_price_check", "SELECT * FROM price_s", OWN)
def j10(d):
    return _price_lines(d)


@query("j10_price_summary", """SELECT scan_id, n AS checked_tags, c AS compliant_tags, CASE WHEN n > 0 THEN round_even(c / n * 100.0e0, 1) END AS compliance_percent,
    CASE WHEN n > 0 THEN 'available' ELSE 'not_observable' END AS state FROM (SELECT scan_id, count(*) FILTER (status <> 'not_observable') AS n,
    count(*) FILTER (status = 'compliant') AS c FROM price_s GROUP BY scan_id)""", OWN)
def j10b(d):
    return MO.price_summary(_price_lines(d))


@query("g68_price_exceptions", """SELECT scan_id, line_no, substr(trim(coalesce(brand, '') || ' ' || coalesce(product_name, '')), 1, 32) AS product, expected_price_inr, detected_price_inr, variance_inr, status
    FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY pos) AS line_no FROM price_s) WHERE line_no <= 20""", OWN)
def g68_price(d):
    return MO.price_exceptions(_price_lines(d))


@query("g18_price", CALC.format(units="price_u"), OWN)
def g18(d):
    return Q.kpi_from_units(Q.price_units(_price_lines(d)))


@query("j12_active_promotions", "SELECT scan_id, kpi_id, state FROM promo_u", OWN)
def j12(d):
    return _promos(d)


@query("g19_promotion", f"""SELECT s.scan_id, 'promotional_compliance' AS kpi_id, k.value, coalesce(k.status, 'not_applicable') AS status,
    coalesce(k.numerator, 0) AS numerator, coalesce(k.denominator, 0) AS denominator, k.coverage_percent, coalesce(k.excluded_count, 0) AS excluded_count
    FROM (SELECT DISTINCT scan_id FROM plan) s LEFT JOIN ({CALC.format(units='promo_u')}) k ON s.scan_id = k.scan_id""", OWN)
def g19(d):
    k = Q.kpi_from_units(_promos(d))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.plan.select("scan_id").distinct().join(k, "scan_id", "left").select(
        "scan_id", F.lit("promotional_compliance").alias("kpi_id"), "value", F.coalesce("status", F.lit("not_applicable")).alias("status"),
        zero("numerator"), zero("denominator"), "coverage_percent", zero("excluded_count"))


@query("g20_location_accuracy", "SELECT * FROM loc_k", OWN)
def g20(d):
    return Q.location_kpi(d.lines)


@query("g21_facing_count", "SELECT * FROM fac_k", OWN)
def g21(d):
    return Q.facing_count(d.plan, d.inv)


@query("g22_linear_share", "SELECT * FROM sos_k", OWN)
def g22(d):
    return Q.linear_share(d.fac, "Brand#1")


@query("g23_role_dashboards", """SELECT s.scan_id, r.role_id, r.slot, r.kpi_id, k.value, coalesce(k.status, 'not_configured') AS status
    FROM (SELECT DISTINCT scan_id FROM all_k) s CROSS JOIN roles r LEFT JOIN all_k k ON s.scan_id = k.scan_id AND r.kpi_id = k.kpi_id""", OWN)
def g23(d):
    return Q.role_dashboards(_all_kpis(d.written()))


@query("g24_readiness", """SELECT scan_id, unnest(['osa', 'planogram_compliance', 'assortment_compliance', 'price_compliance', 'promotional_compliance', 'location_accuracy', 'facing_count', 'share_of_shelf', 'msl_compliance']) AS kpi_id,
    unnest([items, items, ass OR items, price, promo, slot, items, br, msl]) AS ready
    FROM (SELECT coalesce(p.scan_id, k.scan_id) AS scan_id, p.scan_id IS NOT NULL AS items, coalesce(price, false) AS price, coalesce(slot, false) AS slot,
      coalesce(ass, false) AS ass, coalesce(promo, false) AS promo, coalesce(msl, false) AS msl, false AS br
      FROM (SELECT scan_id, bool_or(mrp_inr IS NOT NULL) AS price, bool_or(shelf_position <> '') AS slot FROM plan GROUP BY scan_id) p
      FULL JOIN (SELECT scan_id, bool_or(ln = 2) AS ass, bool_or(ln = 3) AS promo, bool_or(ln = 4) AS msl FROM base GROUP BY scan_id) k ON p.scan_id = k.scan_id)""")
def g24(d):
    package = d.base.where("ln BETWEEN 1 AND 7").select("scan_id", F.try_element_at(F.create_map(
        F.lit(2), F.lit("assortment_skus"), F.lit(3), F.lit("promotions"), F.lit(4), F.lit("msl_skus")), F.col("ln")).alias("list_name"))
    return Q.readiness(d.plan, package).withColumn("ready", F.coalesce("ready", F.lit(False)))
