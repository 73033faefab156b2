"""Queries: validation, file round trips, payloads, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwright.operators import validate as V
from shelfwright.plans.registry import query
from shelfwright.session import ensure_checkpoint_dir
from shelfwright.sources import documents as DO
from shelfwright.sources import tables as T
from shelfwright.sources.keyed_table import KeyedTable

c = F.col
RAWP = {"rawp": """SELECT scan_id, pos, location, CASE WHEN ln = 2 THEN ' ' ELSE brand END AS brand, product_name, category, sub_category, CASE WHEN pos % 7 = 0 THEN 'x1' WHEN pos % 7 = 1 THEN '' WHEN pos % 7 = 2 THEN '-3' ELSE CAST(expected_facings AS VARCHAR) END AS ef,
    CAST(min_facings AS VARCHAR) AS mn, CASE WHEN pos % 11 = 0 THEN '0' ELSE CAST(max_facings AS VARCHAR) END AS mx, CASE WHEN pos % 5 = 0 THEN '' ELSE CAST(expected_qty AS VARCHAR) END AS eq FROM plan""",
        "val": """SELECT *, list_filter([CASE WHEN trim(brand) = '' THEN 'brand is required' END, CASE WHEN ef <> '' AND TRY_CAST(ef AS INT) IS NULL THEN 'expected_facings must be a number' END, CASE WHEN TRY_CAST(ef AS INT) < 0 THEN 'expected_facings must be >= 0' END,
          CASE WHEN ef = '' AND eq = '' THEN 'expected_facings or expected_qty is required' END, CASE WHEN TRY_CAST(mn AS INT) > TRY_CAST(mx AS INT) THEN 'min_facings cannot exceed max_facings' END], lambda x: x IS NOT NULL) AS errors FROM rawp"""}


def _raw_plan(d):
    p = c("pos")
    s = lambda n: c(n).cast("string")
    return d.plan.select(
        "scan_id", "pos", "location", F.when(c("ln") == 2, " ").otherwise(c("brand")).alias("brand"), "product_name", "category", "sub_category", "variant", "sku",
        F.when(p % 7 == 0, "x1").when(p % 7 == 1, "").when(p % 7 == 2, "-3").otherwise(s("expected_facings")).alias("expected_facings"), s("min_facings").alias("min_facings"),
        F.when(p % 11 == 0, "0").otherwise(s("max_facings")).alias("max_facings"), F.lit(None).cast("string").alias("expected_shelf_units"),
        F.when(p % 5 == 0, "").otherwise(s("expected_qty")).alias("expected_qty"), s("mrp_inr").alias("mrp_inr"), s("avg_daily_sales").alias("avg_daily_sales"))


@query("v1_planogram_validation", "SELECT scan_id, pos, array_to_string(errors, ';') AS errors, coalesce(TRY_CAST(nullif(eq, '') AS INT), TRY_CAST(nullif(ef, '') AS INT), 0) AS expected_qty FROM val", RAWP)
def v1(d):
    return V.planogram_rows(_raw_plan(d)).select("scan_id", "pos", F.array_join("errors", ";").alias("errors"), "expected_qty")


@query("v5_validation_summary", "SELECT scan_id, count(*) FILTER (len(errors) = 0) AS valid_count, sum(len(errors)) AS error_count FROM val GROUP BY scan_id", RAWP)
def v5(d):
    return V.validation_summary(V.planogram_rows(_raw_plan(d)), "scan_id")


@query("v2_assortment_validation", """SELECT l_orderkey * 10 + l_linenumber AS row_no, CASE WHEN l_linenumber = 5 THEN '' ELSE 'S' || l_partkey END AS sku, CASE l_returnflag WHEN 'A' THEN 'msl' WHEN 'N' THEN 'optional' ELSE 'other' END AS list_type, CASE WHEN l_suppkey % 2 = 0 THEN 'all' ELSE 'outlet' END AS outlet_scope,
    l_suppkey % 3 = 0 AS substitution_allowed, l_returnflag = 'N' AS optional, CAST(l_linenumber = 5 AS INT) + CAST(l_returnflag = 'R' AS INT) AS n_errors FROM lineitem""")
def v2(d):
    li = d.table("lineitem")
    raw = li.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("row_no"), F.when(c("l_linenumber") == 5, " ").otherwise(F.concat(F.lit("S"), c("l_partkey").cast("string"))).alias("sku"),
                    F.when(c("l_returnflag") == "A", "MSL").when(c("l_returnflag") == "N", " optional").otherwise("other").alias("list_type"), F.when(c("l_suppkey") % 2 == 0, "").otherwise("outlet").alias("outlet_scope"),
                    F.when(c("l_suppkey") % 3 == 0, "Yes").otherwise("no").alias("substitution_allowed"))
    return V.assortment_rows(raw).withColumn("n_errors", F.size("errors")).drop("errors")


@query("v3_price_validation", """SELECT p_partkey AS row_no, 'S' || p_partkey AS sku, CASE WHEN p_size % 2 = 0 THEN 'shelf_tag' ELSE 'rail' END AS label_location, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN -5.0e0 ELSE round_even(p_retailprice, 2) END AS expected_price, 'INR' AS currency, CASE WHEN p_size % 4 <= 1 THEN 1 ELSE 0 END AS n_errors FROM part""")
def v3(d):
    s = c("p_size")
    raw = d.table("part").select(c("p_partkey").alias("row_no"), F.concat(F.lit("S"), c("p_partkey").cast("string")).alias("sku"), F.when(s % 2 == 0, "").otherwise("rail").alias("label_location"),
                                 F.when(s % 4 == 0, "n/a").when(s % 4 == 1, "-5").otherwise(c("p_retailprice").cast("string")).alias("expected_price"), F.lit("").alias("currency"))
    return V.price_rows(raw).withColumn("n_errors", F.size("errors")).drop("errors")


PROMO = """SELECT p_partkey AS row_no, 'P' || p_partkey AS promotion_id, s AS sku, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS required_facings FROM part, LATERAL (SELECT unnest(CASE WHEN p_size % 2 = 0 THEN ['S' || p_partkey, 'S' || (p_partkey + 1)] ELSE ['S' || p_partkey] END) AS s) WHERE p_size % 5 <> 0"""


@query("v4_promotion_validation", PROMO)
def v4(d):
    s, k = c("p_size"), c("p_partkey")
    skus = F.when(s % 2 == 0, F.concat(F.lit("S"), k.cast("string"), F.lit(" | S"), (k + 1).cast("string"), F.lit("|"))).otherwise(F.concat(F.lit("S"), k.cast("string")))
    raw = d.table("part").select(k.alias("row_no"), F.concat(F.lit("P"), k.cast("string")).alias("promotion_id"), skus.alias("participating_skus"), F.lit("").alias("expected_promo_price"),
                                 F.when(s % 5 == 0, "many").when(s % 3 == 0, "").otherwise(s.cast("string")).alias("required_facings"))
    good, _ = V.split_valid(V.promotion_rows(raw))
    return good.select("row_no", "promotion_id", F.explode("participating_skus").alias("sku"), "required_facings")


def _stage(d, name):
    return f"{ensure_checkpoint_dir(d.spark)}/{name}-{uuid.uuid4().hex}"


def _via_csv(d, df, name, **opts):
    """Write rows derived from the tables as CSV to the shared folder, for the source to read."""
    path = _stage(d, name)
    df.write.options(header=True, **opts).csv(path)
    return path


@query("a1_planogram_csv", "SELECT location, product_name, expected_facings, coalesce(expected_qty, 0) AS expected_qty, match_key, count(*) AS n FROM (SELECT location, product_name, expected_facings, expected_facings AS expected_qty, concat_ws('|', lower(brand), lower(product_name), lower(variant), nullif(lower(sku), ''), sub_category) AS match_key FROM plan) GROUP BY ALL")
def a1(d):
    out = d.plan.select(c("location").alias("Store"), c("category").alias("Category"), c("sub_category").alias("Sub-Category"), c("brand").alias("Brand"), c("product_name").alias("Product Name"),
                        c("variant").alias("Pack Size"), c("sku").alias("Product ID"), c("expected_facings").alias("Target Facings"))
    path = _via_csv(d, out, "planogram", sep=";")
    good, _ = V.split_valid(T.read_planogram_csv(d.spark, path))
    return good.groupBy("location", "product_name", "expected_facings", "expected_qty", "match_key").agg(F.count("*").alias("n"))


@query("a2_assortment_csv", "SELECT CASE l_returnflag WHEN 'A' THEN 'msl' ELSE 'optional' END AS list_type, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def a2(d):
    li = d.table("lineitem").select(F.concat(F.lit("S"), c("l_partkey").cast("string")).alias("SKU"), F.when(c("l_returnflag") == "A", "msl").when(c("l_returnflag") == "N", "optional").otherwise("bad").alias("list_type"),
                                    F.lit("all").alias("outlet_scope"), F.lit("true").alias("substitution_allowed"))
    raw = T.read_csv(d.spark, _via_csv(d, li, "assortment")).withColumn("row_no", F.lit(0))
    return V.split_valid(V.assortment_rows(raw))[0].groupBy("list_type").agg(F.count("*").alias("n"))


@query("a3_price_csv", "SELECT 'S' || p_partkey AS sku, round_even(p_retailprice, 2) AS expected_price FROM part")
def a3(d):
    p = d.table("part").select(F.concat(F.lit("S"), c("p_partkey").cast("string")).alias("sku"), F.lit("").alias("label_location"), c("p_retailprice").alias("expected_price"), F.lit("INR").alias("currency"))
    raw = T.read_csv(d.spark, _via_csv(d, p, "prices")).withColumn("row_no", F.lit(0))
    return V.split_valid(V.price_rows(raw))[0].select("sku", "expected_price")


@query("a4_promotion_csv", "SELECT 'P' || p_partkey AS promotion_id, unnest(['S' || p_partkey, 'S' || (p_partkey + 1)]) AS sku FROM part")
def a4(d):
    k = c("p_partkey").cast("string")
    p = d.table("part").select(F.concat(F.lit("P"), k).alias("promotion_id"), F.concat(F.lit("S"), k, F.lit("|S"), (c("p_partkey") + 1).cast("string")).alias("participating_skus"), F.lit("4").alias("required_facings"), F.lit("89").alias("expected_promo_price"))
    raw = T.read_csv(d.spark, _via_csv(d, p, "promotions")).withColumn("row_no", F.lit(0))
    return V.split_valid(V.promotion_rows(raw))[0].select("promotion_id", F.explode("participating_skus").alias("sku"))


@query("a5_scan_payload", """SELECT scan_id, pos, CASE WHEN ln = 7 THEN 'Unknown' ELSE p_brand END AS brand, p_name AS product_name, CASE WHEN ln = 3 THEN 1 ELSE greatest(1, qty) END AS quantity, 1 - l_discount AS confidence,
    CASE WHEN CASE WHEN ln = 3 THEN 1 ELSE greatest(1, qty) END > 2 THEN 'in_stock' ELSE 'low_stock' END AS stock_status FROM (SELECT l_orderkey * 10 + l_linenumber AS scan_id, * EXCLUDE (scan_id) FROM (SELECT l.l_orderkey, l.l_linenumber, b.* FROM base b JOIN lineitem l ON l.l_orderkey = b.scan_id AND l.l_linenumber = b.ln AND l.l_partkey = b.l_partkey AND l.l_suppkey = b.l_suppkey), LATERAL (SELECT 0 AS pos0)) t""".replace("SELECT scan_id, pos, CASE", "SELECT scan_id, 0 AS pos, CASE"))
def a5(d):
    """Payload JSON per counted row, with the field names varying by row."""
    ln = c("ln")
    item = F.concat(F.lit('{"brand":"'), F.when(ln == 7, "").otherwise(c("p_brand")), F.when(ln % 3 == 0, '","name":"').when(ln % 3 == 1, '","product":"').otherwise('","product_name":"'), c("p_name"),
                    F.when(ln % 2 == 0, '","qty":').otherwise('","facings":"'), F.when(ln == 3, "many").otherwise(c("qty").cast("string")), F.when(ln % 2 == 0, "").otherwise('"'),
                    F.lit(',"confidence":'), (1 - c("l_discount")).cast("string"), F.lit("}"))
    pay = d.base.select((c("scan_id") * 10 + ln).alias("scan_id"), F.concat(F.lit('{"products":['), item, F.lit("]}")).alias("payload"))
    return T.payload_products(pay).select("scan_id", "pos", "brand", "product_name", "quantity", "confidence", "stock_status")


@query("a6_taxonomy_json", "SELECT 'r' || r_regionkey AS category_id, r_name AS category, 'n' || n_nationkey AS sub_category_id, n_name AS sub_category FROM region JOIN nation ON n_regionkey = r_regionkey")
def a6(d):
    n = d.table("nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("id"), c("n_name").alias("label"))).alias("subcategories"))  # 25 rows in all
    tax = d.table("region").join(n, c("r_regionkey") == c("n_regionkey")).select(F.concat(F.lit("r"), c("r_regionkey").cast("string")).alias("id"), c("r_name").alias("name"), "subcategories")
    path = _stage(d, "taxonomy")
    tax.write.json(path)
    return d.spark.read.schema("id string, name string, subcategories array<struct<id:string,label:string>>").json(path).transform(T.explode_taxonomy)


@query("a7_manifest_json", "SELECT CAST(item_id AS VARCHAR) AS case_id, 0 AS pos, 'b' AS brand, length(text) % 7 AS expected_facing_count, 0.25e0 AS x1 FROM benchmark")
def a7(d):
    m = F.concat(F.lit('{"cases":[{"id":"'), c("item_id").cast("string"), F.lit('","category":"c","expected_facing_count":'), (F.length("text") % 7).cast("string"),
                 F.lit(',"facings":[{"id":"f","brand":"b","box":[0.25,0.1,0.5,0.9]}]}]}'))
    return T.manifest_facings(d.table("benchmark").select(m.alias("manifest"))).select("case_id", "pos", "brand", "expected_facing_count", c("box")[0].alias("x1"))


@query("a9_keyed_upsert", "SELECT sku, brand, v FROM (SELECT sku, brand, v, row_number() OVER (PARTITION BY sku ORDER BY v DESC) AS rn FROM (SELECT p_partkey AS sku, p_brand AS brand, 0 AS v FROM part UNION ALL SELECT l_partkey, 'L' || max(l_linenumber), 1 + count(*) FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey)) WHERE rn = 1")
def a9(d):
    cur = d.table("part").select(c("p_partkey").alias("sku"), c("p_brand").alias("brand"), F.lit(0).cast("bigint").alias("v"))
    inc = d.table("lineitem").where("l_returnflag = 'A'").groupBy(c("l_partkey").alias("sku")).agg(F.concat(F.lit("L"), F.max("l_linenumber").cast("string")).alias("brand"), (F.count("*") + 1).alias("v"))
    table = KeyedTable(d.spark, _stage(d, "upsert"), "sku", "v", cur.schema, buckets=8)
    table.create(cur)
    table.apply(inc, 0)
    return table.read()


@query("a10_inventory_csv", """SELECT scan_id, brand AS "Brand", product_name AS "Product", quantity AS "Quantity", round_even(confidence * 100.0e0, 1) AS "Confidence %", 'in stock' AS "Stock Status" FROM (SELECT scan_id, brand, product_name, quantity, 0.5e0 + (quantity % 8) / 16.0e0 AS confidence FROM inv)""")
def a10(d):
    inv = d.inv.withColumn("confidence", 0.5 + (c("quantity") % 8) / 16.0)
    path = _stage(d, "inventory")
    T.write_inventory_csv(inv, path)
    back = d.spark.read.option("header", True).schema("scan_id bigint, Brand string, Product string, Variant string, `Shelf Position` string, Category string, Quantity int, `Confidence %` double, a string, b string, c string, d string, `Stock Status` string").csv(path)
    return back.select("scan_id", "Brand", "Product", "Quantity", "Confidence %", "Stock Status")


CELLS = {
    "cells": """SELECT page_id // 2 AS doc_id, page_id % 2 AS page, row, cells FROM (SELECT page_id, unnest(range(0, 4)) AS row, unnest([CASE WHEN page_id % 2 = 0 OR page_id % 8 = 5 THEN ['Item', 'Qty', ''] ELSE ['x' || page_id, '7', 'z'] END, ['a' || page_id, '12', '3.5'], [' ', '', ' '], ['b' || page_id, length(url) || '']]) AS cells FROM pages)""",
    "okc": "SELECT * FROM cells WHERE len(list_filter(cells, lambda c: trim(c) <> '')) > 0",
    "hd": "SELECT doc_id, page, row AS hrow FROM okc WHERE row = 0 AND cells[1] = 'Item'",
}


@query("a14_document_tables", """SELECT o.doc_id, o.page, o.row, 'Item' AS h1, CASE WHEN len(o.cells) >= 1 THEN o.cells[1] END AS c1, coalesce(o.cells[3], '') AS c3 FROM okc o LEFT JOIN hd h ON o.doc_id = h.doc_id AND o.page = h.page WHERE (h.hrow IS NULL OR o.row > h.hrow) AND (h.hrow IS NOT NULL OR EXISTS (SELECT 1 FROM hd p WHERE p.doc_id = o.doc_id AND p.page < o.page))""", CELLS)
def a14(d):
    k = c("page_id")
    s = lambda p: F.concat(F.lit(p), k.cast("string"))
    first = F.when((k % 2 == 0) | (k % 8 == 5), F.array(F.lit("Item"), F.lit("Qty"), F.lit(""))).otherwise(F.array(s("x"), F.lit("7"), F.lit("z")))
    rows = F.array(first, F.array(s("a"), F.lit("12"), F.lit("3.5")), F.array(F.lit(" "), F.lit(""), F.lit(" ")), F.array(s("b"), F.length("url").cast("string")))
    cells = d.table("pages").select(F.floor(k / 2).alias("doc_id"), (k % 2).alias("page"), F.posexplode(rows).alias("row", "cells"))
    t = DO.normalize_tables(cells)
    return t.where(c("header")[0] == "Item").select("doc_id", "page", "row", c("header")[0].alias("h1"), c("cells")[0].alias("c1"), c("cells")[2].alias("c3"))


INV_JSON = '{{"documents":[{{"vendor":"","invoice_id":"I{0}","total":{1},"items":[{{"page":2,"description":"d{0}","quantity":3}},{{"description":""}}]}},{{"vendor":"V{0}","total":0.25,"items":[{{"description":"e","amount":1.5}}]}}]}}'


def _invoices(d):
    a, b = INV_JSON.format("\x01", "\x02").split("\x02")
    text = F.concat(F.lit(a), (c("page_id") % 100).cast("string"), F.lit(".5"), F.lit(b))
    return d.table("pages").select(c("page_id").alias("doc_id"), F.replace(text, F.lit("\x01"), c("page_id").cast("string")).alias("result"))


@query("a15_invoice_items", "SELECT page_id AS doc_id, 0 AS part, 0 AS pos, 2 AS page, 'd' || page_id AS description, 3.0e0 AS quantity, CAST(NULL AS DOUBLE) AS amount FROM pages UNION ALL SELECT page_id, 1, 0, 1, 'e', NULL, 1.5e0 FROM pages")
def a15(d):
    return DO.invoice_items(_invoices(d))


@query("a15_invoice_meta", "SELECT page_id AS doc_id, 'V' || page_id AS vendor, NULL AS customer, 'I' || page_id AS invoice_id, page_id % 100 + 0.75e0 AS total FROM pages")
def a15b(d):
    return DO.invoice_meta(_invoices(d))
