"""Queries: keys, normalisation, taxonomy, text matching, accuracy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwright.functions import keys as K
from shelfwright.functions import text as T
from shelfwright.operators import planogram_match as PM
from shelfwright.operators import text_match as TM
from shelfwright.plans.registry import query

c = F.col


@query("v6_match_key", "SELECT scan_id, pos, concat_ws('|', lower(brand), lower(product_name), lower(variant), nullif(lower(sku), ''), sub_category) AS match_key FROM plan")
def v6(d):
    return d.plan.select("scan_id", "pos", K.match_key(c("brand"), c("product_name"), c("sku"), c("sub_category"), c("variant")).alias("match_key"))


RAW = {"raw": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Lay''S!' WHEN 1 THEN 'Head' WHEN 2 THEN 'CLINIC' WHEN 3 THEN 'haldirams' WHEN 4 THEN p_brand ELSE '  Loui''s ' END AS brand,
    CASE p_partkey % 6 WHEN 1 THEN 'Shoulder care' WHEN 2 THEN 'plus oil' WHEN 3 THEN 'MAD ANGLES' WHEN 4 THEN upper(p_name) ELSE p_name END AS product, CASE p_partkey % 5 WHEN 0 THEN 'Regular, 2 litre' WHEN 1 THEN 'N/A' WHEN 2 THEN 'Single-Serve Bottle' WHEN 3 THEN '6 pack of cans' ELSE p_type END AS variant FROM part"""}


def _raw(d):
    k, v = c("p_partkey") % 6, c("p_partkey") % 5
    return d.table("part").select(
        "p_partkey", F.when(k == 0, " Lay'S!").when(k == 1, "Head").when(k == 2, "CLINIC").when(k == 3, "haldirams").when(k == 4, c("p_brand")).otherwise("  Loui's ").alias("brand"),
        F.when(k == 1, "Shoulder care").when(k == 2, "plus oil").when(k == 3, "MAD ANGLES").when(k == 4, F.upper("p_name")).otherwise(c("p_name")).alias("product"),
        F.when(v == 0, "Regular, 2 litre").when(v == 1, "N/A").when(v == 2, "Single-Serve Bottle").when(v == 3, "6 pack of cans").otherwise(c("p_type")).alias("variant"))


@query("v7_brand_key", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'lays' WHEN 1 THEN 'head & shoulders' WHEN 2 THEN 'clinic plus' WHEN 3 THEN 'haldiram' WHEN 4 THEN replace(lower(brand), '#', '') ELSE 'lays' END AS brand_key FROM raw""", RAW)
def v7(d):
    return _raw(d).select("p_partkey", K.brand_key(c("brand"), c("product")).alias("brand_key"))


@query("v8_product_variant_keys", """SELECT p_partkey, CASE WHEN lower(product) = 'mad angles' THEN 'Mad Angles' ELSE lower(product) END AS product_key, CASE p_partkey % 5 WHEN 1 THEN '' ELSE lower(variant) END AS variant_key,
    CASE p_partkey % 5 WHEN 0 THEN '2l' WHEN 1 THEN '' WHEN 2 THEN 'single serve' WHEN 3 THEN '6pk cans' ELSE lower(variant) END AS merge_key FROM raw""", RAW)
def v8(d):
    return _raw(d).select("p_partkey", K.product_key(c("product")).alias("product_key"), K.variant_key(c("variant")).alias("variant_key"), K.variant_merge_key(c("variant")).alias("merge_key"))


@query("v9_display_labels", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Lays' WHEN 1 THEN 'Head & Shoulders' WHEN 2 THEN 'Clinic Plus' WHEN 3 THEN 'Haldiram' WHEN 4 THEN brand ELSE 'Lays' END AS brand_label,
    CASE p_partkey % 6 WHEN 3 THEN 'Mad Angles' WHEN 4 THEN array_to_string(list_transform(string_split(lower(product), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE product END AS product_label, CASE p_partkey % 5 WHEN 1 THEN '' ELSE variant END AS variant_label FROM raw""", RAW)
def v9(d):
    return _raw(d).select("p_partkey", K.brand_label(c("brand"), c("product")).alias("brand_label"), K.product_label(c("product")).alias("product_label"), K.variant_label(c("variant")).alias("variant_label"))


# Scope of an assignment: by category, sub-category or location, from its priority.
@query("v11_scope_filter", """SELECT p.scan_id, p.pos FROM plan p JOIN scans s ON p.scan_id = s.scan_id WHERE CASE s.priority WHEN '1-URGENT' THEN contains(lower(p.category), 'snacks') WHEN '2-HIGH' THEN p.sub_category = 'sub_3' WHEN '3-MEDIUM' THEN contains(lower(p.location), 'a-1') ELSE true END""")
def v11(d):
    s = d.scans.select("scan_id", F.when(c("priority") == "1-URGENT", "category").when(c("priority") == "2-HIGH", "sub_category").when(c("priority") == "3-MEDIUM", "location").alias("scope"))
    ok = (F.when(c("scope") == "category", F.lower("category").contains("snacks")).when(c("scope") == "sub_category", c("sub_category") == "sub_3")
          .when(c("scope") == "location", F.lower("location").contains("a-1")).otherwise(True))
    return d.plan.join(s, "scan_id").where(ok).select("scan_id", "pos")


@query("v12_sub_category_groups", """SELECT p.scan_id, p.pos, CAST(substr(p.sub_category, 5) AS INT) // 3 = CAST(substr(c.sub_category, 5) AS INT) // 3 AS same_group FROM plan p JOIN cv c ON p.scan_id = c.scan_id AND p.ln = c.ln""")
def v12(d):
    """Sub-categories count as equal when they belong to one sibling group."""
    dim = d.base.select("sub_category").distinct().withColumn("grp", F.floor(F.substring("sub_category", 5, 9).cast("int") / 3))
    p = d.plan.select("scan_id", "pos", "ln", "sub_category").join(dim, "sub_category").select("scan_id", "pos", "ln", c("grp").alias("g1"))
    v = d.cv.select("scan_id", "ln", "sub_category").join(dim, "sub_category").select("scan_id", "ln", c("grp").alias("g2"))
    return p.join(v, ["scan_id", "ln"]).select("scan_id", "pos", (c("g1") == c("g2")).alias("same_group"))


@query("v13_category_alias", "SELECT scan_id, pos, CASE category WHEN 'Snacks' THEN 'snacks & namkeen' WHEN 'Dairy' THEN 'dairy & eggs' ELSE lower(category) END AS aisle FROM plan")
def v13(d):
    # Category spellings and the aisle they belong to.
    alias = K.literal_map({"snacks": "snacks & namkeen", "dairy": "dairy & eggs"})
    return d.plan.select("scan_id", "pos", K.let(K.squash(c("category")), lambda k: F.coalesce(alias[k], k)).alias("aisle"))


RULES = [(["ring"], "jewellery"), (["widget", "gizmo"], "gadgets"), (["hot plate", "cold plate"], "kitchen"), (["bolt", "gear", "rod"], "hardware"), (["anvil"], "forge")]
RULE_SQL = """CASE WHEN regexp_matches({t}, '\\bring\\b') THEN 'jewellery' WHEN contains({t}, 'widget') OR contains({t}, 'gizmo') THEN 'gadgets' WHEN contains({t}, 'hot plate') OR contains({t}, 'cold plate') THEN 'kitchen'
    WHEN regexp_matches({t}, '\\b(bolt|gear|rod)\\b') THEN 'hardware' WHEN contains({t}, 'anvil') THEN 'forge' ELSE 'others' END"""


@query("v14_rule_classification", f"SELECT p_partkey, {RULE_SQL.format(t='p_name')} AS class FROM part")
def v14(d):
    return d.table("part").select("p_partkey", T.first_rule(c("p_name"), RULES, "others").alias("class"))


DOC_RULES = [(["the", "and"], "english"), (["elle", "que"], "french"), (["nicht", "sch"], "german"), (["http", "mail"], "links")]
SQ = "trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))"


@query("v14_document_classes", f"""SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(the|and)([^\\p{{L}}\\p{{N}}_]|$)') THEN 'english' WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(elle|que)([^\\p{{L}}\\p{{N}}_]|$)') THEN 'french' WHEN contains(t, 'nicht') OR regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(sch)([^\\p{{L}}\\p{{N}}_]|$)') THEN 'german'
    WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(http|mail)([^\\p{{L}}\\p{{N}}_]|$)') THEN 'links' ELSE 'others' END AS class FROM (SELECT {SQ} AS t FROM documents)) GROUP BY class""")
def v14b(d):
    return d.spread("documents").select(T.first_rule(c("text"), DOC_RULES, "others").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


ITEMS = {
    "it": "SELECT scan_id, pos, brand, category AS aisle, lower(product_name || ' ' || pack_text) AS text FROM fac",
    "kw": "SELECT DISTINCT category AS class_id, split_part(p_name, ' ', 1) AS word FROM base",
    "sc": """SELECT i.scan_id, i.pos, i.aisle, k.class_id, count(*) AS hits FROM (SELECT scan_id, pos, aisle, unnest(list_distinct(string_split_regex(text, '[^a-z0-9#]+'))) AS word FROM it) i JOIN kw k ON i.word = k.word GROUP BY ALL""",
    "bc": "SELECT brand, min(class_id) AS by_brand FROM (SELECT DISTINCT p_brand AS brand, category AS class_id FROM base) GROUP BY brand HAVING count(*) = 1",
}


def _items(d):
    return d.fac.select("scan_id", "pos", "brand", "product_name", c("category").alias("aisle"), F.lower(F.concat_ws(" ", "product_name", "pack_text")).alias("text"))


def _kw(d):
    return d.base.select(c("category").alias("class_id"), F.split("p_name", " ")[0].alias("word")).distinct()


@query("v15_subcategory_inference", """SELECT i.scan_id, i.pos, coalesce(b.class_id, bc.by_brand) AS class_id FROM it i LEFT JOIN (SELECT scan_id, pos, class_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, pos ORDER BY hits DESC, class_id) AS rn FROM sc) WHERE rn = 1) b
    ON i.scan_id = b.scan_id AND i.pos = b.pos LEFT JOIN bc ON i.brand = bc.brand""", ITEMS)
def v15(d):
    brands = d.base.select(c("p_brand").alias("brand"), c("category").alias("class_id")).distinct()
    return TM.infer_class(_items(d), _kw(d), brands)


@query("v16_foreign_aisle", "SELECT scan_id, pos, class_id AS foreign_class FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, pos ORDER BY hits DESC, class_id) AS rn FROM sc WHERE class_id <> aisle) WHERE rn = 1", ITEMS)
def v16(d):
    return TM.foreign_class(_items(d), _kw(d))


MIS = {**ITEMS, "mis": "SELECT i.scan_id, i.pos, f.brand, f.product_name, class_id AS detected FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, pos ORDER BY hits DESC, class_id) AS rn FROM sc WHERE class_id <> aisle) i JOIN fac f ON i.scan_id = f.scan_id AND i.pos = f.pos WHERE rn = 1"}


def _mis(d):
    return TM.with_foreign_class(_items(d), _kw(d)).select("scan_id", "pos", "brand", "product_name", c("foreign_class").alias("detected"))


@query("g39_mismatch_groups", "SELECT scan_id, detected, brand, product_name, count(*) AS facings FROM mis GROUP BY GROUPING SETS ((scan_id, detected, brand, product_name), (scan_id, detected))", MIS)
def g39(d):
    # Rows are dealt by scan and class once; products are counted there and summed to their class, in place of a second copy of each row.
    per = _mis(d).select("scan_id", "detected", "brand", "product_name").repartition("scan_id", "detected").groupBy("scan_id", "detected", "brand", "product_name").agg(F.count("*").alias("facings"))
    none = F.lit(None).cast("string")
    return per.unionByName(per.groupBy("scan_id", "detected").agg(F.sum("facings").alias("facings")).withColumns({"brand": none, "product_name": none}))


@query("j14_flag_inventory", """SELECT i.scan_id, i.pos, CASE WHEN m.scan_id IS NOT NULL THEN 'category_mismatch' ELSE i.compliance_status END AS compliance_status FROM inv i
    LEFT JOIN (SELECT DISTINCT scan_id, brand, product_name FROM mis) m ON i.scan_id // 8 = m.scan_id AND i.brand = m.brand AND i.product_name = m.product_name""", MIS)
def j14(d):
    m = _mis(d).select(c("scan_id").alias("shelf"), "brand", "product_name", F.lit(True).alias("hit")).distinct()
    i = d.inv.withColumn("shelf", F.floor(c("scan_id") / 8)).join(m, ["shelf", "brand", "product_name"], "left")
    return i.select("scan_id", "pos", F.when(c("hit"), "category_mismatch").otherwise(c("compliance_status")).alias("compliance_status"))


@query("j15_out_of_scope", """SELECT DISTINCT m.scan_id, m.brand, m.product_name FROM mis m WHERE NOT EXISTS (SELECT 1 FROM fac f WHERE f.scan_id = m.scan_id AND f.brand = m.brand AND f.product_name = m.product_name AND NOT EXISTS (SELECT 1 FROM mis x WHERE x.scan_id = f.scan_id AND x.pos = f.pos))""", MIS)
def j15(d):
    """Products whose every facing is a mismatch: they leave the audited scope."""
    m = _mis(d)
    fine = d.fac.join(m.select("scan_id", "pos"), ["scan_id", "pos"], "left_anti").select("scan_id", "brand", "product_name")
    return m.select("scan_id", "brand", "product_name").distinct().join(fine, ["scan_id", "brand", "product_name"], "left_anti")


@query("g40_scope_zones", """SELECT scan_id, count(*) FILTER (z = 'a') AS in_scope, count(*) FILTER (z = 'e') AS adjacent, count(*) FILTER (z = 'u') AS background, count(*) FILTER (z = 'a' AND mm) AS misplaced FROM (
    SELECT f.scan_id, m.pos IS NOT NULL AS mm, CASE WHEN m.pos IS NOT NULL AND ((x1 + x2) / 2.0e0 < 1200 * 0.08e0 OR (x1 + x2) / 2.0e0 > 1200 * 0.92e0 OR (y1 + y2) / 2.0e0 < 900 * 0.08e0 OR (y1 + y2) / 2.0e0 > 900 * 0.92e0) THEN 'e' WHEN m.pos IS NOT NULL THEN 'a' WHEN f.brand = 'Unknown' THEN 'u' ELSE 'a' END AS z
    FROM fac f LEFT JOIN mis m ON f.scan_id = m.scan_id AND f.pos = m.pos) GROUP BY scan_id""", MIS)
def g40(d):
    m = _mis(d).select("scan_id", "pos", F.lit(True).alias("mm"))
    x, y = (c("x1") + c("x2")) / 2.0, (c("y1") + c("y2")) / 2.0
    edge = (x < 1200 * 0.08) | (x > 1200 * 0.92) | (y < 900 * 0.08) | (y > 900 * 0.92)
    z = F.when(c("mm") & edge, "e").when(c("mm"), "a").when(K.is_unclassified(c("brand")), "u").otherwise("a")
    return d.fac.join(m, ["scan_id", "pos"], "left").withColumn("z", z).groupBy("scan_id").agg(
        F.count_if(c("z") == "a").alias("in_scope"), F.count_if(c("z") == "e").alias("adjacent"), F.count_if(c("z") == "u").alias("background"),
        F.count_if((c("z") == "a") & c("mm")).alias("misplaced"))


@query("v17_scope_relaxed_pick", """SELECT scan_id, pos, arg_min(p_partkey, struct_pack(a := CASE WHEN p_type = variant THEN 0 ELSE 1 END, b := -p_size, c := p_partkey)) AS pick FROM fac f JOIN part p ON f.brand = p.p_brand AND f.product_name = p.p_name GROUP BY scan_id, pos""")
def v17(d):
    """Best catalogue entry in the strict scope, else in the relaxed one."""
    p = d.table("part").select(c("p_brand").alias("brand"), c("p_name").alias("product_name"), "p_type", "p_size", "p_partkey")
    # Candidates are reduced per (brand, product, type) before they meet the facings.
    p = p.groupBy("brand", "product_name", "p_type").agg(F.min_by(F.struct("p_size", "p_partkey"), F.struct(-c("p_size"), c("p_partkey"))).alias("b"))
    key = F.struct(F.when(c("p_type") == c("variant"), 0).otherwise(1).alias("a"), (-c("b.p_size")).alias("b"), c("b.p_partkey").alias("c"))
    return d.fac.select("scan_id", "pos", "brand", "product_name", "variant").join(p, ["brand", "product_name"]).groupBy("scan_id", "pos").agg(F.min(key).alias("k")).select("scan_id", "pos", c("k.c").alias("pick"))


@query("v18_learnable", "SELECT scan_id, pos FROM fac WHERE recognition_source IN ('gpt', 'ocr') AND confidence >= 0.95e0 AND brand <> 'Unknown'")
def v18(d):
    src = c("recognition_source")
    return d.fac.where(((src == "gpt") | src.startswith("ocr")) & (c("confidence") >= 0.95) & ~F.lower("brand").isin("unknown", "n/a", "na") & (c("product_name") != "")).select("scan_id", "pos")


@query("v19_label_queue", "SELECT scan_id || '_' || pos AS queue_id FROM fac WHERE brand = 'Unknown' OR confidence < 0.92e0 OR length(trim(pack_text)) < 3")
def v19(d):
    need = K.is_unclassified(c("brand")) | (c("confidence") < 0.92) | (F.length(F.trim("pack_text")) < 3)
    return d.fac.where(need).select(F.concat_ws("_", c("scan_id").cast("string"), c("pos").cast("string")).alias("queue_id"))


@query("v22_quality_disposition", """SELECT CASE WHEN upper(trim(p_type)) IN ('SMALL', 'LARGE') THEN CASE upper(p_type) WHEN 'SMALL' THEN 'SELLABLE' ELSE 'REJECT' END ELSE 'HUMAN_REVIEW' END AS disposition, count(*) AS n,
    sum(CASE WHEN upper(p_type) = 'SMALL' THEN 0 ELSE 2 END) AS defects, round_even(avg(CAST(least(1.0e0, greatest(0.0e0, p_size / 40.0e0)) AS DECIMAL(20,6))), 4) AS confidence FROM part GROUP BY 1""")
def v22(d):
    raw = F.when(c("p_type") == "SMALL", " sellable ").when(c("p_type") == "LARGE", "Reject").otherwise(c("p_type"))
    # Quality dispositions.
    disp = K.let(F.replace(F.upper(F.trim(raw)), F.lit(" "), F.lit("_")), lambda v: F.when(v.isin("SELLABLE", "REJECT", "MARKDOWN", "HUMAN_REVIEW"), v).otherwise("HUMAN_REVIEW"))
    rows = d.table("part").select(disp.alias("disposition"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("p_size") / 40.0)).alias("conf"), F.array(F.lit("bruise"), F.lit(" "), F.lit("rot ")).alias("defects"))
    kept = F.when(c("disposition") == "SELLABLE", 0).otherwise(F.size(F.filter("defects", lambda x: F.trim(x) != "")))
    return rows.groupBy("disposition").agg(F.count("*").alias("n"), F.sum(kept).alias("defects"), F.bround(F.avg(c("conf").cast("decimal(20,6)")).cast("double"), 4).alias("confidence"))


@query("v23_catalogue_pollution", "SELECT p_partkey FROM part WHERE NOT (p_type = 'PROMO' AND contains(p_name, 'ring')) AND p_brand NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) < 6)")
def v23(d):
    p = d.table("part")
    reject = p.groupBy("p_brand").agg(F.count_distinct("p_type").alias("n")).where("n < 6").select("p_brand")
    return p.where(~((c("p_type") == "PROMO") & c("p_name").contains("ring"))).join(reject, "p_brand", "left_anti").select("p_partkey")


@query("v25_expand_units", "SELECT scan_id, pos, unnest(range(1, greatest(1, quantity) + 1)) AS unit FROM inv")
def v25(d):
    return d.inv.select("scan_id", "pos", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), c("quantity")))).alias("unit"))


@query("v26_allow_block_lists", """SELECT f.scan_id, f.pos FROM fac f WHERE contains(lower(pack_text), lower(brand)) OR (NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size = 50 AND b.p_brand = f.brand AND 'sub_' || (b.p_partkey % 11) = f.sub_category) AND NOT regexp_matches(lower(pack_text), 'anvil|rod'))""")
def v26(d):
    """Blocked (sub-category, brand) pairs and reject tokens drop a row unless its text names the brand."""
    block = d.table("part").where("p_size = 50").select(c("p_brand").alias("brand"), F.concat(F.lit("sub_"), (c("p_partkey") % 11).cast("string")).alias("sub_category"), F.lit(True).alias("blocked")).distinct()
    named = F.lower("pack_text").contains(F.lower("brand"))
    j = d.fac.join(block, ["brand", "sub_category"], "left")
    return j.where(named | (c("blocked").isNull() & ~F.lower("pack_text").rlike("anvil|rod"))).select("scan_id", "pos")


@query("v27_slug_metadata", """SELECT p_partkey, 'Brand' || substr(p_brand, 7) AS brand, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS product_name, p_size || ' ml' AS variant FROM part""")
def v27(d):
    s = F.concat_ws("-", F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_")), c("p_size").cast("string"), F.lit("ml"))
    tok = F.filter(F.split(F.replace(F.lower(s), F.lit("-"), F.lit("_")), "_"), lambda t: t != "")
    sized = F.element_at(tok, -1).isin("ml", "g", "kg", "l") | F.element_at(tok, -1).rlike("^[0-9]+$")
    n = F.size(tok)
    body = F.when(sized, F.slice(tok, F.lit(2), n - 3)).otherwise(F.slice(tok, F.lit(2), n - 1))
    return d.table("part").select("p_partkey", F.initcap(tok[0]).alias("brand"), F.initcap(F.array_join(body, " ")).alias("product_name"),
                                  F.when(sized, F.array_join(F.slice(tok, -2, 2), " ")).otherwise("").alias("variant"))


@query("f9_clean_text", "SELECT p_partkey, 'O' || p_name || ' l' || lower(p_type) || ' broo' AS t FROM part")
def f9(d):
    noisy = F.concat(F.lit("0"), c("p_name"), F.lit("   1"), c("p_type"), F.lit(" brooo0"))
    return d.table("part").select("p_partkey", T.clean_read_text(noisy).alias("t"))


@query("f10_volume_slug_shelf", "SELECT p_partkey, p_size || 'ml' AS volume, replace(lower(p_brand), '#', '_') || '_' || replace(p_name, ' ', '_') AS slug, p_size AS shelf FROM part")
def f10(d):
    vol = T.volume_tokens(F.concat(c("p_name"), F.lit(" "), c("p_size").cast("string"), F.lit(" ML pack")))
    return d.table("part").select("p_partkey", vol[0].alias("volume"), T.slug(c("p_brand"), c("p_name")).alias("slug"), T.shelf_number(F.concat(F.lit("Shelf "), c("p_size").cast("string"), F.lit(" / Position 1"))).alias("shelf"))


@query("f11_token_overlap", """SELECT scan_id, pos, round_even(len(list_intersect(a, b)) / CAST(greatest(len(a), len(b)) AS DOUBLE), 4) AS overlap FROM (SELECT p.scan_id, p.pos, list_distinct(string_split(lower(p.brand || ' ' || p.product_name), ' ')) AS a, list_distinct(string_split(lower(c.brand || ' ' || c.product_name || ' ' || c.variant), ' ')) AS b FROM plan p JOIN cv c ON p.scan_id = c.scan_id AND p.pos = c.pos)""")
def f11(d):
    tok = lambda *x: F.array_distinct(F.split(F.lower(F.concat_ws(" ", *x)), " "))
    j = d.plan.select("scan_id", "pos", tok("brand", "product_name").alias("a")).join(d.cv.select("scan_id", "pos", tok("brand", "product_name", "variant").alias("b")), ["scan_id", "pos"])
    return j.select("scan_id", "pos", F.bround(PM.overlap(c("a"), c("b")), 4).alias("overlap"))


@query("u4_token_subset", "SELECT scan_id, pos, list_has_all(string_split(lower(pack_text), ' '), string_split(lower(product_name), ' ')) AS named FROM fac")
def u4(d):
    a, b = F.split(F.lower("product_name"), " "), F.split(F.lower("pack_text"), " ")
    return d.fac.select("scan_id", "pos", (F.size(F.array_except(a, b)) == 0).alias("named"))


CER = {"acc": """SELECT scan_id, pos, category, CASE WHEN pack_text = '' THEN 1.0e0 ELSE levenshtein(lower(product_name), lower(pack_text)) / CAST(length(product_name) AS DOUBLE) END AS cer,
    contains(lower(brand), lower(pack_text)) OR contains(lower(pack_text), lower(brand)) OR contains(regexp_replace(lower(pack_text), '[^a-z0-9]', '', 'g'), regexp_replace(lower(brand), '[^a-z0-9]', '', 'g')) AS brand_ok,
    contains(lower(pack_text), lower(product_name)) OR contains(lower(product_name), lower(pack_text)) OR len(list_intersect(string_split(lower(product_name), ' '), string_split(lower(pack_text), ' '))) / CAST(len(list_distinct(string_split(lower(product_name), ' '))) AS DOUBLE) >= 0.5e0 AS product_ok FROM fac"""}


def _acc(d):
    return d.fac.select("scan_id", "pos", "category", T.error_rate(c("product_name"), c("pack_text")).alias("cer"), T.brand_equal(c("brand"), c("pack_text")).alias("brand_ok"), T.product_equal(c("product_name"), c("pack_text")).alias("product_ok"))


@query("f12_error_rate", "SELECT scan_id, pos, round_even(cer, 6) AS cer FROM acc", CER)
def f12(d):
    return _acc(d).select("scan_id", "pos", F.bround("cer", 6).alias("cer"))


@query("f13_fuzzy_equality", "SELECT scan_id, pos, brand_ok, product_ok FROM acc", CER)
def f13(d):
    return _acc(d).select("scan_id", "pos", "brand_ok", "product_ok")


RATES = "SELECT category, count(*) AS n, round_even(count(*) FILTER (brand_ok) * 100.0e0 / count(*), 1) AS brand_rate, round_even(count(*) FILTER (product_ok) * 100.0e0 / count(*), 1) AS product_rate, round_even(CAST(sum(CAST(cer AS DECIMAL(20,10))) AS DOUBLE) / count(*) * 100.0e0, 1) AS cer_percent FROM acc GROUP BY ROLLUP (category)"


@query("g48_accuracy_rates", RATES, CER)
def g48(d):
    return TM.accuracy_rates(_acc(d), "category")


@query("g49_quality_gates", f"SELECT category, CASE WHEN product_rate < 95 THEN 'FAIL' ELSE 'PASS' END AS product_gate, CASE WHEN brand_rate < 50 THEN 'FAIL' ELSE 'PASS' END AS brand_gate FROM ({RATES})", CER)
def g49(d):
    return TM.quality_gates(TM.accuracy_rates(_acc(d), "category"), 95.0, 50.0)


@query("g50_label_coverage", """SELECT lang, source, count(*) AS documents, count(l.doc_id) AS labelled, CASE WHEN count(l.doc_id) >= 20 THEN 'ready' WHEN count(l.doc_id) > 0 THEN 'partial' ELSE 'missing' END AS state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang, source""")
def g50(d):
    lab = d.table("labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    j = d.table("documents").select("doc_id", "lang", "source").join(lab, "doc_id", "left").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.count("has").alias("labelled"))
    return j.withColumn("state", F.when(c("labelled") >= 20, "ready").when(c("labelled") > 0, "partial").otherwise("missing"))


@query("g69_sample_per_class", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 15")
def g69(d):
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return d.table("documents").select("doc_id", "source", rn.alias("rn")).where("rn <= 15").drop("rn")


CORR = {
    "tk": "SELECT id, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id AS id, string_split_regex(trim(text, ' '), '\\s+') AS w FROM documents)",
    "tw": "SELECT id, pos, token, lower(regexp_replace(token, '[^a-zA-Z0-9]', '', 'g')) AS w FROM tk",
    "vo": "SELECT DISTINCT w FROM (SELECT lower(regexp_replace(unnest(string_split_regex(trim(text, ' '), '\\s+')), '[^a-zA-Z0-9]', '', 'g')) AS w FROM benchmark) WHERE length(w) >= 3",
    "dt": "SELECT DISTINCT w FROM tw WHERE length(w) >= 4 AND w NOT IN (SELECT w FROM vo)",
    "fx": """SELECT w, v AS fixed FROM (SELECT d.w, v.w AS v, row_number() OVER (PARTITION BY d.w ORDER BY 1.0e0 - levenshtein(d.w, v.w) / CAST(greatest(length(d.w), length(v.w)) AS DOUBLE) DESC, v.w) AS rn FROM dt d JOIN vo v ON abs(length(d.w) - length(v.w)) <= 0.18e0 * greatest(length(d.w), length(v.w)) + 1e-9
        AND 1.0e0 - levenshtein(d.w, v.w) / CAST(greatest(length(d.w), length(v.w)) AS DOUBLE) >= 0.82e0) WHERE rn = 1""",
}


def _vocab(d):
    w = F.explode(F.split(F.trim("text"), r"\s+"))
    return d.table("benchmark").select(w.alias("t")).select(F.lower(F.regexp_replace("t", "[^a-zA-Z0-9]", "")).alias("w")).where(F.length("w") >= 3)


@query("j28_token_correction", "SELECT t.id, t.pos, t.token, f.fixed FROM tw t JOIN fx f ON t.w = f.w", CORR)
def j28(d):
    return TM.correct_texts(d.spread("documents").select(c("doc_id").alias("id"), "text"), _vocab(d))


JT = {
    "tx": "SELECT pos * 2 + scan_id % 2 AS k, scan_id, pos, lower(pack_text) AS text, brand, product_name FROM fac",
    "ca": "SELECT p_partkey AS sku, lower(p_brand) AS brand_token, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS words FROM part",
    "mt": """SELECT scan_id, pos, sku, score FROM (SELECT t.scan_id, t.pos, c.sku, round_even(0.5e0 * (len(list_intersect(c.words, tw)) / CAST(len(c.words) AS DOUBLE)) + 0.5e0 + 0.0e0, 4) AS score FROM (SELECT *, list_distinct(string_split_regex(text, '[^a-z0-9#]+')) AS tw FROM tx) t JOIN ca c ON list_contains(t.tw, c.brand_token))
        QUALIFY row_number() OVER (PARTITION BY scan_id, pos ORDER BY score DESC, sku) = 1""",
}


def _matched(d):
    cat = d.table("part").select(c("p_partkey").alias("sku"), F.lower("p_brand").alias("brand_token"),
        F.array_distinct(F.split(F.concat_ws(" ", c("p_name"), F.lower("p_type")), " ")).alias("words"), F.lit(None).cast("string").alias("volume"))
    # Equal words of a brand are one candidate: the smallest SKU wins anyway.
    cat = cat.groupBy("brand_token", F.array_sort("words").alias("words"), "volume").agg(F.min("sku").alias("sku"))
    # Texts repeat a lot: each distinct text is matched once and joined back.
    texts = d.fac.select(F.lower("pack_text").alias("id"), F.lower("pack_text").alias("text")).distinct()
    m = TM.match_products(texts, cat)
    return d.fac.withColumn("id", F.lower("pack_text")).join(m, "id").select("scan_id", "pos", "product_name", m["sku"].alias("sku"), "score")


@query("j27_text_to_product", "SELECT scan_id, pos, sku, score FROM mt", JT)
def j27(d):
    return _matched(d).select("scan_id", "pos", "sku", "score")


@query("g67_golden_text_accuracy", "SELECT count(*) AS n, round_even(count(*) FILTER (p.p_name = f.product_name) * 100.0e0 / count(*), 1) AS accuracy FROM mt m JOIN fac f ON m.scan_id = f.scan_id AND m.pos = f.pos JOIN part p ON m.sku = p.p_partkey", JT)
def g67(d):
    p = d.table("part").select(c("p_partkey").alias("sku"), "p_name")
    return _matched(d).join(p, "sku").agg(F.count("*").alias("n"), F.bround(F.count_if(c("p_name") == c("product_name")) * 100.0 / F.count("*"), 1).alias("accuracy"))


CAND = {
    "sc33": """SELECT f.scan_id, f.pos, p.ppos, CASE WHEN contains(f.t, p.b) THEN least(1.0e0, 1.0e0 * 0.55e0 + len(list_intersect(list_distinct(string_split(p.n, ' ')), list_distinct(string_split(f.t, ' ')))) / CAST(greatest(len(list_distinct(string_split(p.n, ' '))), len(list_distinct(string_split(f.t, ' ')))) AS DOUBLE) * 0.33e0
        + CASE WHEN contains(f.t, p.s) THEN 0.12e0 ELSE 0.0e0 END + least(0.35e0, len(list_filter(string_split(p.n, ' '), lambda w: length(w) >= 4 AND contains(f.t, w))) * 0.08e0)) ELSE 0.0e0 END AS score
        FROM (SELECT scan_id, pos, lower(pack_text) AS t FROM fac WHERE pack_text <> '') f JOIN (SELECT scan_id // 8 AS scan_id, pos * 8 + scan_id % 8 AS ppos, lower(brand) AS b, lower(product_name) AS n, sub_category AS s FROM plan) p ON f.scan_id = p.scan_id""",
    "b33": "SELECT scan_id, pos, ppos, score FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, pos ORDER BY score DESC, ppos) AS rn FROM sc33) WHERE rn = 1 AND score >= 0.38e0",
}


def _best_candidates(d):
    f = d.fac.where("pack_text <> ''").select("scan_id", "pos", F.lower("pack_text").alias("t"))
    p = d.plan.select(F.floor(c("scan_id") / 8).alias("scan_id"), (c("pos") * 8 + c("scan_id") % 8).alias("ppos"), F.lower("brand").alias("b"), F.lower("product_name").alias("n"), c("sub_category").alias("s"))
    p = p.groupBy("scan_id", "b", "n", "s").agg(F.min("ppos").alias("ppos"))
    # A score above zero needs the brand in the text: facings are keyed by every brand of the catalogue they name.
    brands = d.table("part").select(F.lower("p_brand").alias("b")).distinct()
    from shelfwright.operators.planogram_match import related_brands
    named = related_brands(f.select(c("t").alias("bk")).distinct(), brands.select(c("b").alias("bk"))).select(c("a").alias("t"), "b")
    j = f.join(named, "t").join(p, ["scan_id", "b"])
    s = TM.candidate_score(c("t"), c("b"), c("n"), c("s"))
    return j.withColumn("score", s).where(c("score") >= 0.38).groupBy("scan_id", "pos").agg(
        F.min_by(F.struct("ppos", "score"), F.struct(-c("score"), c("ppos"))).alias("m")).select("scan_id", "pos", "m.ppos", "m.score")


@query("j33_text_to_planogram", "SELECT scan_id, pos, ppos, round_even(score, 6) AS score FROM b33", CAND)
def j33(d):
    return _best_candidates(d).withColumn("score", F.bround("score", 6))
