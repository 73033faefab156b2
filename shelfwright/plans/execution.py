"""Queries: comparison, documents, rules, actions, ledger, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwright.operators import compare as CP
from shelfwright.operators import money as MO
from shelfwright.operators import planogram_calc as P
from shelfwright.operators import shelf_metrics as M
from shelfwright.plans import planogram as PP
from shelfwright.plans import shelf_metrics as SM
from shelfwright.plans import sqlkit as S
from shelfwright.plans.registry import query
from shelfwright.session import cut_lineage

c = F.col
CMP = {
    "e_": """SELECT scan_id, lower(replace(brand, '#', '')) || '|' || lower(product_name || ' ' || variant) AS key, min(pos) AS i, sum(coalesce(nullif(expected_qty, 0), 1)) AS expected_qty, count(*) AS slots, arg_min(brand, pos) AS brand, arg_min(product_name, pos) AS product_name, arg_min(variant, pos) AS variant,
        arg_min(sku, pos) AS sku, arg_min(sub_category, pos) AS sub, arg_min(location, pos) AS location FROM plan GROUP BY 1, 2""",
    "a_": """SELECT scan_id, lower(replace(brand, '#', '')) || '|' || lower(product_name || ' ' || variant) AS key, min(pos) AS j, sum(CASE WHEN quantity = 0 THEN facings ELSE quantity END) AS quantity, round_even(CAST(sum(CAST(confidence AS DECIMAL(20,8))) AS DOUBLE) / count(*), 4) AS confidence,
        arg_min(brand, pos) AS brand, arg_min(product_name, pos) AS product_name, arg_min(variant, pos) AS variant, arg_min(category, pos) AS category FROM inv GROUP BY 1, 2""",
    "cs": """SELECT e.scan_id AS g, e.i AS l, a.j AS r, CASE WHEN NOT (contains(e.bk, a.bk) OR contains(a.bk, e.bk)) THEN 0 WHEN e.p = a.p THEN 0.95e0 WHEN contains(e.p, a.p) OR contains(a.p, e.p) THEN 0.88e0 WHEN ov >= 0.5e0 THEN 0.6e0 + 0.4e0 * ov ELSE 0.62e0 END AS score
        FROM (SELECT *, lower(replace(brand, '#', '')) AS bk, lower(product_name || ' ' || variant) AS p FROM e_) e JOIN (SELECT *, lower(replace(brand, '#', '')) AS bk, lower(product_name || ' ' || variant) AS p FROM a_) a ON e.scan_id = a.scan_id,
        LATERAL (SELECT len(list_intersect(list_distinct(string_split(e.p, ' ')), list_distinct(string_split(a.p, ' ')))) / CAST(greatest(len(list_distinct(string_split(e.p, ' '))), len(list_distinct(string_split(a.p, ' ')))) AS DOUBLE) AS ov) o""",
    "cs45": "SELECT * FROM cs WHERE score >= 0.45e0",
    **S.greedy_walk("cs45", "l, score DESC", "cw"),
    "clines": """SELECT e.scan_id, e.i, a.j, CASE WHEN a.j IS NULL THEN 'missing' WHEN a.quantity <> e.expected_qty THEN 'qty_mismatch' ELSE 'correct' END AS issue_type, e.brand AS expected_brand, e.product_name AS expected_product, e.expected_qty, a.brand AS actual_brand, a.product_name AS actual_product,
        coalesce(a.quantity, 0) AS actual_qty, CASE WHEN a.j IS NULL THEN CASE WHEN e.expected_qty > 0 THEN 'critical' ELSE 'warning' END WHEN a.quantity = e.expected_qty THEN 'info' ELSE 'warning' END AS severity
        FROM e_ e LEFT JOIN cw_chosen w ON e.scan_id = w.g AND e.i = w.l LEFT JOIN a_ a ON a.scan_id = w.g AND a.j = w.r
        UNION ALL SELECT scan_id, NULL, j, 'unexpected', NULL, NULL, 0, brand, product_name, quantity, 'warning' FROM a_ a WHERE NOT EXISTS (SELECT 1 FROM cw_chosen w WHERE w.g = a.scan_id AND w.r = a.j)""",
}


@query("g3_merge_by_product", "SELECT scan_id, key, quantity, confidence, product_name FROM a_", CMP)
def g3(d):
    return CP.merge_inventory(d.inv).select("scan_id", "key", "quantity", "confidence", "product_name")


@query("g4_plan_totals", "SELECT scan_id, key, expected_qty, slots FROM e_", CMP)
def g4(d):
    return CP.plan_totals(d.plan).select("scan_id", "key", "expected_qty", "slots")


def _pairs(d):
    d = d.by_scan()
    return CP.compare_pairs(d.plan, d.inv)


def _compared(d):
    d = d.by_scan()
    return CP.compare_planogram(d.plan, d.inv)


@query("j8_compare_scores", "SELECT g AS scan_id, l AS i, r AS j, score FROM cs45", CMP)
def j8(d):
    return _pairs(d)


@query("j32_variant_lookup", "SELECT g AS scan_id, r AS j, min(l) AS i FROM cs45 GROUP BY g, r", CMP)
def j32(d):
    """First planned row, in plan order, that an inventory row is compatible with."""
    return _pairs(d).groupBy("scan_id", "j").agg(F.min("i").alias("i"))


@query("j7_compare_planogram", "SELECT * FROM clines", CMP)
def j7(d):
    return _compared(d)


KINDS = {"sub_0": ["ring", "bolt"], "sub_1": ["plate"], "sub_2": ["widget", "gear"], "sub_4": ["rod"], "sub_5": ["anvil", "gizmo"]}
NAMED = "coalesce(len(list_filter({kw}, lambda w: contains({t}, w))) > 0 OR len({kw}) = 0, false)"
LADDER = f"""CASE WHEN e.p = a.p THEN 0.95e0 WHEN contains(e.p, a.p) OR contains(a.p, e.p) THEN 0.88e0 WHEN ov >= 0.5e0 THEN 0.6e0 + 0.4e0 * ov WHEN {NAMED.format(kw='e.kw', t='a.p')} THEN 0.62e0 ELSE 0.45e0 END"""
OVER = "LATERAL (SELECT len(list_intersect(list_distinct(string_split(e.p, ' ')), list_distinct(string_split(a.p, ' ')))) / CAST(greatest(len(list_distinct(string_split(e.p, ' '))), len(list_distinct(string_split(a.p, ' ')))) AS DOUBLE) AS ov) o"
WORDS_OF = "CASE sub " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KINDS.items()) + " ELSE [] END"
FULL = {
    **CMP,
    "plan_s": "SELECT * FROM plan WHERE sub_category NOT IN ('sub_2', 'sub_5', 'sub_7')",
    "e_": CMP["e_"].replace("FROM plan ", "FROM plan_s "),
    "ek": f"SELECT *, lower(replace(brand, '#', '')) AS bk, lower(product_name || ' ' || variant) AS p, CAST({WORDS_OF} AS VARCHAR[]) AS kw FROM e_",
    "ak": "SELECT *, lower(replace(brand, '#', '')) AS bk, lower(product_name || ' ' || variant) AS p FROM a_",
    "csk": f"SELECT * FROM (SELECT e.scan_id AS g, e.i AS l, a.j AS r, {LADDER} AS score FROM ek e JOIN ak a ON e.scan_id = a.scan_id AND (contains(e.bk, a.bk) OR contains(a.bk, e.bk)), {OVER}) WHERE score >= 0.45e0",
    **S.greedy_walk("csk", "l, score DESC", "ck"),
    "cx": "SELECT scan_id, store_id, CASE WHEN scan_id % 3 > 0 THEN '' ELSE 'sub_' || (scan_id % 5) END AS scan_sub, CASE WHEN scan_id % 4 = 0 THEN '' ELSE 'here' END AS aisle FROM scans",
    "aw": f"""SELECT u.scan_id, u.j, arg_min(p.location, p.pos) AS away FROM (SELECT a.*, x.store_id FROM ak a JOIN cx x ON a.scan_id = x.scan_id AND x.aisle <> '' WHERE NOT EXISTS (SELECT 1 FROM ck_chosen w WHERE w.g = a.scan_id AND w.r = a.j)) u
        JOIN (SELECT DISTINCT ON (store_id, location, bk, p, kw) * FROM (SELECT s.store_id, pl.pos, lower(pl.location) AS location, lower(replace(brand, '#', '')) AS bk, lower(product_name || ' ' || variant) AS p, CAST({WORDS_OF.replace('CASE sub', 'CASE sub_category')} AS VARCHAR[]) AS kw FROM plan pl JOIN scans s ON pl.scan_id = s.scan_id) ORDER BY store_id, location, bk, p, kw, pos) p
        ON u.store_id = p.store_id AND u.bk = p.bk, LATERAL (SELECT u.p AS q) q, LATERAL (SELECT len(list_intersect(list_distinct(string_split(p.p, ' ')), list_distinct(string_split(u.p, ' ')))) / CAST(greatest(len(list_distinct(string_split(p.p, ' '))), len(list_distinct(string_split(u.p, ' ')))) AS DOUBLE) AS ov) o
        WHERE {LADDER.replace('e.', 'p.').replace('a.p', 'u.p')} >= 0.6e0 AND NOT EXISTS (SELECT 1 FROM plan_s h WHERE h.scan_id = u.scan_id AND lower(h.location) = p.location) GROUP BY u.scan_id, u.j""",
    "fl": f"""SELECT e.scan_id, e.i, a.j, e.brand AS eb, e.product_name AS ep, e.expected_qty AS eq, a.brand AS ab, a.product_name AS ap, coalesce(a.quantity, 0) AS aq, k.score, e.sub, x.scan_sub,
        {NAMED.format(kw='e.kw', t='a.p')} AS agrees, CASE WHEN a.j % 4 = 0 THEN 'sub_' || (a.j % 7) ELSE x.scan_sub END AS det
        FROM ek e JOIN cx x ON e.scan_id = x.scan_id LEFT JOIN ck_chosen w ON e.scan_id = w.g AND e.i = w.l LEFT JOIN csk k ON k.g = w.g AND k.l = w.l AND k.r = w.r LEFT JOIN ak a ON a.scan_id = w.g AND a.j = w.r""",
    "fi": """SELECT *, CASE WHEN j IS NULL THEN 'missing' WHEN NOT (scan_sub <> '' AND CAST(substr(sub, 5) AS INT) // 3 = TRY_CAST(substr(scan_sub, 5) AS INT) // 3) AND det <> '' AND CAST(substr(sub, 5) AS INT) // 3 <> TRY_CAST(substr(det, 5) AS INT) // 3 THEN 'wrong_category'
        WHEN score < 0.6e0 AND NOT agrees THEN 'wrong_product' WHEN aq <> eq THEN 'qty_mismatch' ELSE 'correct' END AS issue FROM fl""",
}


@query("j7_all_issue_types", """SELECT scan_id, i, j, issue AS issue_type, eb AS expected_brand, ep AS expected_product, eq AS expected_qty, ab AS actual_brand, ap AS actual_product, aq AS actual_qty,
    CASE issue WHEN 'missing' THEN CASE WHEN eq > 0 THEN 'critical' ELSE 'warning' END WHEN 'wrong_category' THEN 'critical' WHEN 'correct' THEN 'info' ELSE 'warning' END AS severity,
    CASE WHEN issue IN ('missing', 'qty_mismatch') THEN 'Expected ' || eq || ', found ' || aq WHEN issue = 'wrong_category' THEN 'Expected sub-category ' || sub WHEN issue = 'wrong_product' THEN 'Detected product does not match expected SKU/name'
      WHEN score < 0.6e0 THEN 'Brand and product type match (variant name differs)' ELSE 'OK' END AS detail FROM fi
    UNION ALL SELECT a.scan_id, NULL, a.j, CASE WHEN w.away IS NULL THEN 'unexpected' ELSE 'wrong_location' END, NULL, NULL, 0, brand, product_name, quantity, CASE WHEN w.away IS NULL THEN 'warning' ELSE 'critical' END, coalesce(w.away, 'Not in expected planogram for this assignment')
    FROM ak a LEFT JOIN aw w ON a.scan_id = w.scan_id AND a.j = w.j WHERE NOT EXISTS (SELECT 1 FROM ck_chosen x WHERE x.g = a.scan_id AND x.r = a.j)""", FULL)
def j7b(d):
    """Every issue type; audits of some sub-category, rows with a recognised one, and words that name kinds."""
    d = d.by_scan()
    blank = lambda when, other: F.when(when, "").otherwise(other)
    context = d.scans.select("scan_id", "store_id", blank(c("scan_id") % 3 > 0, F.concat(F.lit("sub_"), (c("scan_id") % 5).cast("string"))).alias("sub_category"), blank(c("scan_id") % 4 == 0, F.lit("here")).alias("aisle"))
    groups = d.spark.range(64).select(F.concat(F.lit("sub_"), c("id").cast("string")).alias("sub_category"), F.floor(c("id") / 3).alias("grp"))
    kinds = d.spark.createDataFrame([(k, w) for k, v in KINDS.items() for w in v], "sub_category string, word string")
    detected = CP.merge_inventory(d.inv).where("pos % 4 = 0").select("scan_id", c("pos").alias("j"), F.concat(F.lit("sub_"), (c("pos") % 7).cast("string")).alias("sub_category"))
    scope = d.plan.where(~c("sub_category").isin("sub_2", "sub_5", "sub_7"))  # what this audit covers
    return CP.compare_in_context(scope, d.inv, context, groups, kinds, detected, d.plan)


@query("u1_union_of_lines", "SELECT issue_type, severity, count(*) AS n FROM clines GROUP BY ALL", CMP)
def u1(d):
    return _compared(d).groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


@query("g44_compare_summary", """SELECT scan_id, count(i) AS expected_products, count(*) FILTER (issue_type = 'missing') AS missing_products, count(*) FILTER (issue_type = 'qty_mismatch') AS quantity_issues, count(*) FILTER (issue_type = 'unexpected') AS unexpected_products,
    count(*) FILTER (issue_type = 'correct') AS correct_products, round_even(100.0e0 * (greatest(count(i), 1) - count(*) FILTER (issue_type = 'missing')) / greatest(count(i), 1), 2) AS sku_match_percent FROM clines GROUP BY scan_id""", CMP)
def g44b(d):
    return CP.compare_summary(_compared(d))


@query("r4_corrective_actions", """SELECT scan_id, i, j, issue_type, CASE WHEN issue_type = 'qty_mismatch' AND actual_qty > expected_qty THEN 'Remove ' || (actual_qty - expected_qty) || ' extra facing(s) of ' || actual_brand || ' ' || actual_product || '.'
    WHEN issue_type IN ('missing', 'qty_mismatch') THEN 'Replenish ' || expected_brand || ' ' || expected_product || ' — ' || greatest(0, expected_qty - actual_qty) || ' unit(s) required.' ELSE 'Review unexpected product: ' || actual_brand || ' ' || actual_product || '.' END AS suggestion FROM clines WHERE issue_type <> 'correct'""", CMP)
def r4(d):
    return CP.suggestions(_compared(d))


@query("j9_wrong_location", """SELECT u.scan_id, u.j, arg_min(p.location, p.pos) AS expected_aisle FROM (SELECT a.*, s.store_id FROM a_ a JOIN scans s ON a.scan_id = s.scan_id) u
    JOIN (SELECT s.store_id, p.pos, p.location, lower(replace(brand, '#', '')) AS bk, lower(product_name || ' ' || variant) AS p FROM plan p JOIN scans s ON p.scan_id = s.scan_id) p
    ON u.store_id = p.store_id AND lower(replace(u.brand, '#', '')) = p.bk, LATERAL (SELECT lower(u.product_name || ' ' || u.variant) AS q) q, LATERAL (SELECT len(list_intersect(list_distinct(string_split(p.p, ' ')), list_distinct(string_split(q.q, ' ')))) / CAST(greatest(len(list_distinct(string_split(p.p, ' '))), len(list_distinct(string_split(q.q, ' ')))) AS DOUBLE) AS ov) o
    WHERE CASE WHEN p.p = q.q THEN 0.95e0 WHEN contains(p.p, q.q) OR contains(q.q, p.p) THEN 0.88e0 WHEN ov >= 0.5e0 THEN 0.6e0 + 0.4e0 * ov ELSE 0.45e0 END >= 0.6e0 AND NOT EXISTS (SELECT 1 FROM plan h WHERE h.scan_id = u.scan_id AND h.location = p.location) GROUP BY u.scan_id, u.j""", CMP)
def j9(d):
    d, stores = d.by_scan(), d.scans.select("scan_id", "store_id")
    inv = CP.merge_inventory(d.inv)
    a = inv.select("scan_id", c("pos").alias("j"), CP._features(inv, F.lit("")).alias("a")).join(stores, "scan_id")
    plan = d.plan.withColumn("sku", F.lit(""))
    e = plan.select("scan_id", "pos", c("location").alias("aisle"), CP._features(plan, F.lit("")).alias("e")).join(stores, "scan_id").drop("scan_id")
    return CP.wrong_location(a, e, d.plan.select("scan_id", c("location").alias("aisle")).distinct())


# --- reference documents -------------------------------------------------------------------
DOC = {
    "docl": """SELECT p.scan_id, p.pos, p.ln, p.attached, p.match_status, CASE WHEN p.ln % 2 = 0 THEN p.expected_facings * 2 END AS invoice_qty, p.actual_visible_units AS shelf_units, p.brand, p.location, p.location_label, p.mrp_inr, p.visible_price, p.expected_qty, c.promotion_text,
        CASE WHEN p.expected_qty % 3 = 0 THEN 'Buy 2' WHEN p.expected_qty % 3 = 1 THEN 'none' END AS offer FROM prows p LEFT JOIN cv c ON p.scan_id = c.scan_id AND p.pos = c.pos""",
    "docs": """SELECT *, CASE WHEN found AND promotion_text IS NOT NULL THEN 'p' END AS shelf_promo, CASE WHEN expected_qty % 3 = 0 THEN 'Buy 2' END AS exp_promo FROM (SELECT *, CASE WHEN attached AND match_status = 'MATCHED' THEN 'FOUND' WHEN attached AND match_status = 'BRAND_MATCHED' THEN 'FOUND_VARIANT_UNVERIFIED'
        WHEN match_status = 'UNVERIFIABLE' AND EXISTS (SELECT 1 FROM cv u WHERE u.scan_id = docl.scan_id AND u.ln = 7) THEN 'UNCLEAR' ELSE 'MISSING' END AS presence_status, attached AND match_status IN ('MATCHED', 'BRAND_MATCHED') AS found FROM docl)""",
}


def document_lines(d):
    """Per-line presence, quantity and promotion status of a reference document."""
    promo = d.cv.select("scan_id", "pos", "promotion_text")
    extra = F.create_map(F.lit("Unit"), F.lit("pc"), F.lit("Offer text"), F.when(c("expected_qty") % 3 == 0, "Buy 2").when(c("expected_qty") % 3 == 1, "none"))
    rows = d.prows.join(promo, ["scan_id", "pos"], "left").withColumns({
        "invoice_qty": F.when(c("ln") % 2 == 0, c("expected_facings") * 2), "extra_fields": extra})
    unread = d.cv.where("ln = 7").select("scan_id").distinct().withColumn("left_over", F.lit(True))
    ms = c("match_status")
    presence = F.when(c("attached") & (ms == "MATCHED"), "FOUND").when(c("attached") & (ms == "BRAND_MATCHED"), "FOUND_VARIANT_UNVERIFIED").when(
        (ms == "UNVERIFIABLE") & c("left_over").isNotNull(), "UNCLEAR").otherwise("MISSING")
    # Column names that hold an offer, and texts that mean no offer.
    offers = F.map_values(F.map_filter("extra_fields", lambda k, v: F.lower(k).rlike("promo|offer|scheme|deal") & ~F.lower(F.trim(F.coalesce(v, F.lit("")))).isin(
        "", "null", "none", "n/a", "na", "-", "no", "no offer", "no promotion")))
    j = rows.join(unread, "scan_id", "left").withColumns({"presence_status": presence, "expected_promo": F.try_element_at(offers, F.lit(1))})
    found = c("presence_status").startswith("FOUND")
    units = F.when(found, c("actual_visible_units"))
    shelf = F.when(found, c("promotion_text"))
    qty = F.when(~found, "NOT_ON_SHELF").when(c("invoice_qty").isNull(), "NO_EXPECTED").when(units.isNull(), "NOT_COUNTED").when(units >= c("invoice_qty"), "COVERED").otherwise("BELOW_DOCUMENT")
    pst = F.when(~found, "NOT_ON_SHELF").when(c("expected_promo").isNotNull(), F.when(shelf.isNotNull(), "PROMO_SEEN").otherwise("PROMO_NOT_SEEN")).when(shelf.isNotNull(), "UNEXPECTED_PROMO").otherwise("NO_EXPECTED")
    from shelfwright.functions import location as L
    price = F.when(found, L.price_status(c("mrp_inr"), c("visible_price")))
    return j.select("scan_id", "pos", "presence_status", qty.alias("qty_status"), pst.alias("promo_status"), price.alias("price_status"), "invoice_qty", units.alias("shelf_units"))


DLINE = """SELECT scan_id, pos, presence_status, CASE WHEN NOT found THEN 'NOT_ON_SHELF' WHEN invoice_qty IS NULL THEN 'NO_EXPECTED' WHEN shelf_units IS NULL THEN 'NOT_COUNTED' WHEN shelf_units >= invoice_qty THEN 'COVERED' ELSE 'BELOW_DOCUMENT' END AS qty_status,
    CASE WHEN NOT found THEN 'NOT_ON_SHELF' WHEN exp_promo IS NOT NULL THEN CASE WHEN shelf_promo IS NOT NULL THEN 'PROMO_SEEN' ELSE 'PROMO_NOT_SEEN' END WHEN shelf_promo IS NOT NULL THEN 'UNEXPECTED_PROMO' ELSE 'NO_EXPECTED' END AS promo_status,
    CASE WHEN found THEN CASE WHEN mrp_inr IS NULL THEN 'NO_EXPECTED' WHEN vp IS NULL THEN 'NOT_READABLE' WHEN round_even(vp, 2) = round_even(mrp_inr, 2) THEN 'MATCH' ELSE 'MISMATCH' END END AS price_status, invoice_qty, CASE WHEN found THEN shelf_units END AS shelf_units
    FROM (SELECT *, TRY_CAST(nullif(regexp_extract(visible_price, '[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS vp FROM docs)"""


@query("j11_reference_lines", DLINE, DOC)
def j11(d):
    return document_lines(d)


@query("f21_promo_from_columns", "SELECT scan_id, pos, CASE WHEN expected_qty % 3 = 0 THEN 'Buy 2' END AS promo FROM plan")
def f21(d):
    extra = F.create_map(F.lit("Unit"), F.lit("pc"), F.lit("Deal"), F.when(c("expected_qty") % 3 == 0, "Buy 2").when(c("expected_qty") % 3 == 1, "none"))
    hit = F.map_values(F.map_filter(extra, lambda k, v: F.lower(k).rlike("promo|offer|scheme|deal") & v.isNotNull() & (F.lower(v) != "none")))
    return d.plan.select("scan_id", "pos", F.try_element_at(hit, F.lit(1)).alias("promo"))


VERDICT = "CASE WHEN pct >= 90 AND mism = 0 THEN 'MATCHES' WHEN pct >= 60 THEN 'PARTIAL' ELSE 'DOES_NOT_MATCH' END"


@query("f24_reference_verdict", f"""SELECT scan_id, lines_total, lines_found, lines_unclear, pct AS presence_percent, mism AS price_mismatched, qty_covered, {VERDICT} AS verdict FROM (SELECT scan_id, count(*) AS lines_total, count(*) FILTER (presence_status LIKE 'FOUND%') AS lines_found, count(*) FILTER (presence_status = 'UNCLEAR') AS lines_unclear,
    round_even(count(*) FILTER (presence_status LIKE 'FOUND%') * 100.0e0 / count(*), 1) AS pct, count(*) FILTER (price_status = 'MISMATCH') AS mism, count(*) FILTER (qty_status = 'COVERED') AS qty_covered FROM ({DLINE}) GROUP BY scan_id)""", DOC)
def f24(d):
    n = F.count("*")
    found = F.count_if(c("presence_status").startswith("FOUND"))
    agg = document_lines(d).groupBy("scan_id").agg(n.alias("lines_total"), found.alias("lines_found"), F.count_if(c("presence_status") == "UNCLEAR").alias("lines_unclear"),
        F.bround(found * 100.0 / n, 1).alias("presence_percent"), F.count_if(c("price_status") == "MISMATCH").alias("price_mismatched"), F.count_if(c("qty_status") == "COVERED").alias("qty_covered"))
    pct = c("presence_percent")
    return agg.withColumn("verdict", F.when((pct >= 90) & (c("price_mismatched") == 0), "MATCHES").when(pct >= 60, "PARTIAL").otherwise("DOES_NOT_MATCH"))


# --- rules, actions, ledger ----------------------------------------------------------------
RSK = {
    **PP.OWN, **PP.CHECK,
    "stp": "SELECT scan_id, min(CASE WHEN min_max_status = 'BELOW_MIN' THEN pos END) AS stop, count(*) FILTER (match_status = 'NOT_FOUND') AS nf FROM rowm2 GROUP BY scan_id",
    "live": "SELECT r.* FROM rowm2 r JOIN stp s ON r.scan_id = s.scan_id WHERE s.stop IS NULL OR r.pos < s.stop",
    "pcmp": "SELECT scan_id, round_even(sum(passed) / sum(applicable) * 100.0e0, 1) AS pc FROM checks GROUP BY scan_id",
    "trig": """SELECT scan_id, 'expected_units_zero_actual' AS rule_id, 4 AS sev FROM live WHERE expected_shelf_units > 0 AND coalesce(actual_visible_units, 0) = 0
        UNION ALL SELECT scan_id, 'visible_unit_shortfall', 2 FROM live WHERE expected_shelf_units > 0 AND coalesce(actual_visible_units, 0) <> 0 AND expected_shelf_units - actual_visible_units >= 5
        UNION ALL SELECT scan_id, 'coverage_critical', 4 FROM live WHERE coverage_days <= 1 UNION ALL SELECT scan_id, 'coverage_high', 3 FROM live WHERE coverage_days > 1 AND coverage_days <= 3
        UNION ALL SELECT s.scan_id, 'count_mismatch', 4 FROM stp s JOIN chk2 k ON s.scan_id = k.scan_id WHERE k.scan_status = 'COUNT_MISMATCH' UNION ALL SELECT scan_id, 'planogram_not_found', 3 FROM stp WHERE nf >= 3
        UNION ALL SELECT scan_id, 'below_min_facings', 3 FROM stp WHERE stop IS NOT NULL UNION ALL SELECT scan_id, 'planogram_compliance_low', 2 FROM pcmp WHERE pc < 70""",
}


@query("r1_execution_risk", """SELECT s.scan_id, CASE coalesce(max(t.sev), 0) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'NONE' END AS severity, count(t.sev) AS rules, coalesce(array_to_string(list_sort(list(DISTINCT t.rule_id) FILTER (t.rule_id IS NOT NULL)), ','), '') AS rule_ids
    FROM stp s LEFT JOIN trig t ON s.scan_id = t.scan_id GROUP BY s.scan_id""", RSK)
def r1(d):
    return CP.execution_risk(P.row_metrics(d.prows), PP._verified(d).select("scan_id", "scan_status"), P.check_compliance(d.prows).select("scan_id", "planogram_compliance"))


MET = {
    **SM.PLACED,
    "evi": "SELECT scan_id, count(*) FILTER (issue_type = 'missing') AS verified_shelf_absence_count FROM lines GROUP BY scan_id",
    "met": "SELECT p.*, coalesce(e.verified_shelf_absence_count, 0) AS verified_shelf_absence_count FROM placed2 p LEFT JOIN evi e ON p.scan_id = e.scan_id",
    "nba": """SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY rule_no, pos) AS rank FROM (
        SELECT scan_id, 1 AS rule_no, 'oos' AS rule_id, 'critical' AS priority, 'Replenish ' || verified_shelf_absence_count || ' out-of-stock SKU(s)' AS title, NULL AS pos, NULL AS brand, NULL AS product FROM met WHERE verified_shelf_absence_count > 0
        UNION ALL SELECT scan_id, 2, 'low_stock', 'high', 'Replenish ' || low_stock_products || ' low-stock SKU(s)', NULL, NULL, NULL FROM met WHERE low_stock_products > 0
        UNION ALL SELECT scan_id, 3, 'placement', 'high', 'Fix ' || misplaced_facings || ' placement issue(s)', NULL, NULL, NULL FROM met WHERE misplaced_facings > 0
        UNION ALL SELECT scan_id, 4, coalesce(issue_type, 'planogram'), CASE WHEN issue_type IN ('missing', 'wrong_product') THEN 'critical' ELSE 'high' END, 'Planogram: ' || expected_brand || ' ' || expected_product, pos, expected_brand, expected_product FROM lines WHERE coalesce(issue_type, '') <> 'correct')""",
    "nba12": "SELECT * FROM nba WHERE rank <= 12",
}


def _metrics(d):
    ev = d.lines.groupBy("scan_id").agg(F.count_if(c("issue_type") == "missing").alias("verified_shelf_absence_count"))
    return SM._placed(d).join(ev, "scan_id", "left").withColumn("verified_shelf_absence_count", F.coalesce("verified_shelf_absence_count", F.lit(0)))


@query("r2_alerts", """SELECT scan_id, 1 AS rule_no, 'oos' AS rule_id, 'high' AS priority, verified_shelf_absence_count || ' verified shelf absence(s)' AS title FROM met WHERE verified_shelf_absence_count > 0
    UNION ALL SELECT scan_id, 2, 'low-stock', CASE WHEN low_stock_products > 10 THEN 'high' ELSE 'medium' END, low_stock_products || ' SKUs below facing threshold' FROM met WHERE low_stock_products > 0
    UNION ALL SELECT scan_id, 3, 'placement', 'high', misplaced_facings || ' placement issues detected' FROM met WHERE misplaced_facings > 0""", MET)
def r2(d):
    return CP.alerts(_metrics(d))


@query("r3_recommendations", """SELECT scan_id, 1 AS rule_no, 'replenish-oos' AS rule_id, 'high' AS priority, 'Review ' || verified_shelf_absence_count || ' verified shelf absence(s)' AS title FROM met WHERE verified_shelf_absence_count > 0
    UNION ALL SELECT scan_id, 2, 'replenish-low', 'high', 'Replenish ' || low_stock_products || ' low-stock SKUs' FROM met WHERE low_stock_products > 0
    UNION ALL SELECT scan_id, 3, 'fix-placement', 'high', 'Fix ' || misplaced_facings || ' misplaced facings' FROM met WHERE misplaced_facings > 0 UNION ALL SELECT scan_id, 4, 'planogram', 'medium', 'Restore planogram compliance' FROM met WHERE planogram_percent < 85""", MET)
def r3(d):
    return CP.recommendations(_metrics(d))


@query("t3_next_actions", "SELECT scan_id, rule_no, rule_id, priority, title, rank FROM nba12", MET)
def t3(d):
    return CP.next_actions(_metrics(d), d.lines).drop("pos")


@query("f22_impact_score", """SELECT scan_id, pos, round_even(CASE WHEN mrp_inr > 0 THEN least(mrp_inr * 5 / 10000.0e0, 1.0e0) ELSE 0.25e0 END * CASE ln WHEN 1 THEN 1.0e0 WHEN 2 THEN 0.85e0 ELSE 0.5e0 END * greatest(0.1e0, 0.75e0) * CASE ln WHEN 1 THEN 1.0e0 WHEN 2 THEN 0.9e0 ELSE 0.6e0 END * 100.0e0, 1) AS score FROM plan""")
def f22(d):
    pr = F.when(c("ln") == 1, "critical").when(c("ln") == 2, "high").otherwise("other")
    return d.plan.select("scan_id", "pos", CP.impact_score(F.coalesce(c("mrp_inr") * 5, F.lit(0.0)), pr, F.lit(0.75), pr).alias("score"))


LED = {**MET, **PP.MONEY,
       "imp": PP.IMPACT.format(t="imp_l"),
       "led": """SELECT *, CASE rule_id WHEN 'missing' THEN 'availability' WHEN 'wrong_product' THEN 'availability' WHEN 'oos' THEN 'availability' WHEN 'low_stock' THEN 'availability' WHEN 'qty_mismatch' THEN 'facing' ELSE rule_id END AS root,
          round_even(CASE WHEN inr > 0 THEN least(inr / 10000.0e0, 1.0e0) ELSE 0.25e0 END * CASE priority WHEN 'critical' THEN 1.0e0 ELSE 0.85e0 END * 0.75e0 * CASE priority WHEN 'critical' THEN 1.0e0 ELSE 0.9e0 END * 100.0e0, 1) AS score
          FROM (SELECT a.*, CASE WHEN coalesce(i.level, 1) >= 2 THEN coalesce(i.daily_inr, 0) / count(*) OVER (PARTITION BY a.scan_id) ELSE 0 END AS inr FROM nba12 a LEFT JOIN imp i ON a.scan_id = i.scan_id)"""}


@query("t4_opportunity_ledger", """SELECT scan_id, brand, product, root, rule_id, score, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, rank) AS place FROM (SELECT scan_id, lower(coalesce(brand, '')) AS brand, lower(coalesce(product, '')) AS product, root, rule_id, score, rank,
    row_number() OVER (PARTITION BY scan_id, lower(coalesce(brand, '')), lower(coalesce(product, '')), root ORDER BY score DESC, rank) AS rn FROM led) WHERE rn = 1 QUALIFY place <= 25""", LED)
def t4(d):
    d = d.written()
    names = d.lines.select("scan_id", "pos", c("expected_brand").alias("brand"), c("expected_product").alias("product"))
    acts = cut_lineage(CP.next_actions(_metrics(d), d.lines)).join(names, ["scan_id", "pos"], "left")
    return CP.opportunity_ledger(acts, MO.impact_from_lines(d.lines, d.plan))


@query("g43_image_quality", """SELECT scan_id, CASE WHEN seen THEN greatest(0.0e0, least(100.0e0, round_even(det - e * 2 - w * 1.5e0, 0))) ELSE least(det, 85.0e0) END AS quality_score, det AS detection_score, retake AS rescan_recommended,
    CASE WHEN retake THEN 'retake_required' WHEN CASE WHEN seen THEN greatest(0.0e0, least(100.0e0, round_even(det - e * 2 - w * 1.5e0, 0))) ELSE least(det, 85.0e0) END < 85 THEN 'acceptable' ELSE 'good' END AS status FROM (
    SELECT *, greatest(0.0e0, least(100.0e0, round_even(100.0e0 - greatest(0.0e0, 50.0e0 - cov), 0))) AS det, (seen AND w / t > 0.35e0) OR (seen AND e / t > 0.25e0) OR cov < 50 AS retake FROM (
    SELECT q.scan_id, e, w, (av > 0 OR e + w > 0) AS seen, greatest(c.total_facings, 1) AS t, c.recognition_coverage_percent AS cov FROM (SELECT scan_id, count(*) FILTER (length(trim(pack_text)) < 3) AS e, count(*) FILTER (length(trim(pack_text)) >= 3 AND ocr_confidence < 0.55e0) AS w,
      max(ocr_confidence) AS av FROM fac GROUP BY scan_id) q JOIN core c ON q.scan_id = c.scan_id))""", SM.OWN)
def g43(d):
    m = M.facing_quality(d.fac).join(M.scan_metrics(d.inv, d.fac).select("scan_id", "total_facings", "recognition_coverage_percent"), "scan_id")
    return CP.image_quality(m)


@query("g44_assortment_breadth", """SELECT e.scan_id, expected, greatest(0, expected - coalesce(found, 0)) AS missing, round_even(coalesce(found, 0) / expected * 100.0e0, 1) AS breadth_percent FROM (SELECT scan_id, count(*) AS expected FROM plan GROUP BY scan_id) e
    LEFT JOIN (SELECT scan_id, count(*) FILTER (issue_type IN ('correct', 'qty_mismatch')) AS found FROM lines GROUP BY scan_id) f ON e.scan_id = f.scan_id""")
def g44(d):
    return CP.assortment_breadth(d.plan, d.lines)


@query("g45_availability", """SELECT *, round_even(greatest(0.0e0, 100.0e0 - oos_rate - low_stock_rate * 0.5e0), 1) AS basic_osa FROM (SELECT e.scan_id, round_even(coalesce(v.verified_shelf_absence_count, 0) / expected * 100.0e0, 1) AS oos_rate, round_even(coalesce(v.low_stock_products, 0) / expected * 100.0e0, 1) AS low_stock_rate
    FROM (SELECT scan_id, count(*) AS expected FROM plan GROUP BY scan_id) e LEFT JOIN met v ON e.scan_id = v.scan_id)""", MET)
def g45(d):
    return CP.availability_block(d.plan, _metrics(d).withColumn("confirmed_oos_count", c("verified_shelf_absence_count")))


FUL = "SELECT scan_id, sum(coalesce(expected_qty, 0)) AS expected_facings, sum(least(actual_qty, coalesce(expected_qty, 0))) AS actual_facings, sum(greatest(0, coalesce(expected_qty, 0) - actual_qty)) AS facing_gap, CASE WHEN sum(coalesce(expected_qty, 0)) > 0 THEN round_even(sum(least(actual_qty, coalesce(expected_qty, 0))) / sum(coalesce(expected_qty, 0)) * 100.0e0, 1) END AS fulfilment_percent FROM lines GROUP BY scan_id"


@query("g46_facing_fulfilment", FUL)
def g46(d):
    return CP.facing_fulfilment(d.lines)


@query("g64_primary_brand", "SELECT scan_id, arg_min(brand, struct_pack(n := -n, p := first_pos)) AS primary_brand FROM (SELECT scan_id, brand, count(*) AS n, min(pos) AS first_pos FROM plan GROUP BY ALL) GROUP BY scan_id")
def g64(d):
    per = d.plan.groupBy("scan_id", "brand").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return per.groupBy("scan_id").agg(F.min_by("brand", F.struct(-c("n"), c("p"))).alias("primary_brand"))


@query("g65_package_lists", """SELECT scan_id, 'assortment' AS list_name, sku, NULL AS price FROM plan WHERE sku <> '' AND scan_id % 4 <> 0 UNION ALL SELECT scan_id, 'assortment', 'SUP-' || CAST(l_suppkey AS VARCHAR), NULL FROM base WHERE ln = 7 AND scan_id % 4 = 0
    UNION ALL SELECT scan_id, 'assortment', sku, NULL FROM plan p WHERE sku <> '' AND scan_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.scan_id = p.scan_id AND b.ln = 7) UNION ALL SELECT scan_id, 'price', sku, mrp_inr FROM plan WHERE sku <> '' AND mrp_inr IS NOT NULL""")
def g65(d):
    """A supplied list wins; where a planogram has none, the list is derived from its rows."""
    none = F.lit(None).cast("double")
    supplied = d.base.where("ln = 7 AND scan_id % 4 = 0").select("scan_id", F.concat(F.lit("SUP-"), c("l_suppkey").cast("string")).alias("sku"))
    derived = d.plan.where("sku <> ''").select("scan_id", "sku").join(supplied.select("scan_id").distinct(), "scan_id", "left_anti")
    a = supplied.unionByName(derived).select("scan_id", F.lit("assortment").alias("list_name"), "sku", none.alias("price"))
    return a.unionByName(d.plan.where("sku <> '' AND mrp_inr IS NOT NULL").select("scan_id", F.lit("price").alias("list_name"), "sku", c("mrp_inr").alias("price")))


@query("g68_exception_list", "SELECT scan_id, pos, issue_type FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY pos) AS rn FROM lines) WHERE rn <= 25 AND coalesce(issue_type, '') <> 'correct'")
def g68(d):
    """The first lines of a scan, then the exceptions among them: the limit comes before the filter."""
    rn = F.row_number().over(Window.partitionBy("scan_id").orderBy("pos"))
    return d.lines.withColumn("rn", rn).where("rn <= 25").where(F.coalesce("issue_type", F.lit("")) != "correct").select("scan_id", "pos", "issue_type")


@query("u2_key_union", "SELECT coalesce(p.scan_id, a.scan_id) AS scan_id, coalesce(p.brand, a.brand) AS brand, p.brand IS NOT NULL AS planned, a.brand IS NOT NULL AS seen FROM (SELECT DISTINCT scan_id, brand FROM plan) p FULL JOIN (SELECT DISTINCT scan_id, brand FROM cv) a ON p.scan_id = a.scan_id AND p.brand = a.brand")
def u2(d):
    p = d.plan.select("scan_id", "brand", F.lit(1).alias("planned"), F.lit(0).alias("seen"))
    a = d.cv.select("scan_id", "brand", F.lit(0).alias("planned"), F.lit(1).alias("seen"))
    return p.unionByName(a).groupBy("scan_id", "brand").agg((F.max("planned") == 1).alias("planned"), (F.max("seen") == 1).alias("seen"))
