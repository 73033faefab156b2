"""File sources and sinks: CSV with header aliases, scan payloads, taxonomy, manifests, catalogue."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.operators import validate as V
from shelfwright.session import cut_lineage

# Header spellings accepted for each planogram column.
HEADER_ALIASES = {
    "location": ["location", "store"], "aisle": ["aisle"], "category": ["category"],
    "sub_category": ["sub-category", "subcategory", "sub category", "sub_category"], "brand": ["brand"],
    "product_name": ["product", "product name", "product_name"], "variant": ["variant", "size", "pack size"],
    "expected_facings": ["expected facings", "expected_facings", "facings", "target facings"],
    "min_facings": ["min facings", "min_facings"], "max_facings": ["max facings", "max_facings"],
    "expected_shelf_units": ["expected shelf units", "expected_shelf_units", "shelf units"],
    "expected_qty": ["expected qty", "expected quantity", "qty", "quantity", "expected_qty"],
    "sku": ["sku", "product id", "product_id", "productid"], "shelf_position": ["shelf position", "position", "shelf_position"],
    "mrp_inr": ["mrp", "mrp inr", "mrp_inr", "price", "price inr"],
    "avg_daily_sales": ["daily sales", "avg daily sales", "sales", "velocity", "units per day", "avg_daily_sales"],
}
_CANONICAL = {alias: name for name, aliases in HEADER_ALIASES.items() for alias in aliases}
REQUIRED = ["location", "category", "sub_category", "brand", "product_name"]


def canonical_header(header: str) -> str:
    key = re.sub(r"\s+", " ", header.replace("﻿", "").strip().lower())
    return _CANONICAL.get(key, key.replace(" ", "_"))


def separator_of(line: str) -> str:
    """';' when the header line has more of them than commas."""
    return ";" if line.count(";") > line.count(",") else ","


def text_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Lines of all files, the header line of each file (written, so that files are read for it once), and the different header lines, which are all that reaches the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    heads = cut_lineage(lines.where("block = 0").groupBy("source_file").agg(F.min_by("value", "n").alias("line")))
    return lines, heads, sorted(r.line for r in heads.select("line").distinct().collect())


def header_names(line: str, sep: str | None) -> list[str]:
    return [canonical_header(c) for c in next(csv.reader([line], delimiter=sep or separator_of(line)), [])]


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All-string rows under canonical headers, with the file each row came from.

    Each file is read under its own header and separator; a column that a file lacks is null, and of columns with one canonical name the
    first counts. Files are read as text in one pass and each line is parsed by the header of its file, which it meets in parts, so that one
    large file is no hot key. Lines equal to the header are headers again; blank lines are skipped.
    """
    return parsed_lines(spark, *text_lines(spark, path), sep)


def parsed_lines(spark: SparkSession, lines: DataFrame, heads: DataFrame, headers: list[str], sep: str | None = None) -> DataFrame:
    """Rows of ``text_lines``, each line parsed once: a generator keeps filters on the columns from repeating the parse."""
    if not headers:
        return spark.createDataFrame([], "source_file string")
    salts = 16
    heads = heads.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    rows = lines.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(salts)).cast("int")).join(heads, ["source_file", "salt"]).where((F.col("value") != F.col("line")) & (F.trim("value") != ""))
    names = {h: header_names(h, sep) for h in headers}
    every = list(dict.fromkeys(n for h in headers for n in names[h]))

    def parsed(line: str):
        first_of = {n: i for i, n in reversed(list(enumerate(names[line])))}
        schema = ", ".join(f"c{i} string" for i in range(len(names[line])))
        row = F.from_csv("value", schema, {"sep": sep or separator_of(line), "quote": '"', "escape": '"'})
        fields = lambda p: F.struct(*[(p[f"c{first_of[n]}"] if n in first_of else F.lit(None).cast("string")).alias(n) for n in every])
        return F.when(F.col("line") == F.lit(line), F.transform(F.array(row), fields)[0])

    out = rows.select(F.explode(F.array(F.coalesce(*[parsed(h) for h in headers]))).alias("r"), "source_file")
    return out.select(*[F.col("r").getField(n).alias(n) for n in every if n != "source_file"], "source_file")


def read_planogram_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Validated planogram rows; files without the required columns are refused with the names of the columns."""
    lines, heads, headers = text_lines(spark, path)
    for line in headers:
        names = header_names(line, sep)
        missing = [c for c in REQUIRED if c not in names]
        if not {"expected_facings", "expected_qty"} & set(names):
            missing.append("expected_facings or expected_qty")
        if missing:
            raise ValueError("missing required column: " + ", ".join(missing))
    df = parsed_lines(spark, lines, heads, headers, sep)
    for c in HEADER_ALIASES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return V.planogram_rows(df)


def write_inventory_csv(inventory: DataFrame, path: str) -> None:
    """Inventory export with twelve named columns, one folder per scan batch."""
    inventory_export(inventory).write.mode("overwrite").option("header", True).csv(path)


def inventory_export(inventory: DataFrame) -> DataFrame:
    c, blank = F.col, F.lit("")
    opt = lambda n: F.coalesce(c(n).cast("string"), blank) if n in inventory.columns else blank
    status = F.coalesce(c("stock_status"), F.lit("in_stock")) if "stock_status" in inventory.columns else F.lit("in_stock")
    return inventory.select(
        "scan_id", c("brand").alias("Brand"), c("product_name").alias("Product"), c("variant").alias("Variant"), opt("shelf_position").alias("Shelf Position"),
        c("category").alias("Category"), c("quantity").alias("Quantity"), F.bround(F.coalesce(c("confidence"), F.lit(0.0)) * 100.0, 1).alias("Confidence %"),
        F.coalesce(F.nullif(opt("compliance_alert"), blank), F.lit("OK")).alias("Compliance Alert"), opt("compliance_interpretation").alias("Compliance Note"),
        opt("detected_sub_category_label").alias("Detected Sub-category"), opt("expected_sub_category_label").alias("Audit Sub-category"),
        F.replace(status, F.lit("_"), F.lit(" ")).alias("Stock Status"))


PRODUCT = ("struct<brand:string,product:string,product_name:string,name:string,variant:string,qty:string,quantity:string,facings:string,actual_facings:string,"
           "actual_visible_units:string,confidence:string,shelf_position:string,position:string,shelf:string,product_category:string,category:string>")


def payload_products(payloads: DataFrame) -> DataFrame:
    """Scan payloads (scan_id, payload) to product rows, tolerant of alternative field names."""
    parsed = payloads.select("scan_id", F.from_json("payload", f"struct<products:array<{PRODUCT}>>", {"mode": "PERMISSIVE"}).alias("p"))
    rows = parsed.select("scan_id", F.posexplode_outer("p.products").alias("pos", "r"))
    first = lambda d, *names: F.coalesce(*[F.nullif(F.trim(F.col(f"r.{n}")), F.lit("")) for n in names], F.lit(d))
    qty = F.coalesce(*[F.nullif(F.nullif(F.trim(F.col(f"r.{n}")), F.lit("")), F.lit("0")) for n in ("qty", "quantity", "facings", "actual_facings", "actual_visible_units")], F.lit("1"))
    q = F.greatest(F.lit(1), F.coalesce(qty.try_cast("int"), F.lit(1)))
    return rows.where("r IS NOT NULL").select(
        "scan_id", "pos", first("Unknown", "brand").alias("brand"), first("Unknown", "product_name", "product", "name").alias("product_name"), first("", "variant").alias("variant"),
        q.alias("quantity"), F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        first("", "shelf_position", "position", "shelf").alias("shelf_position"), first("", "product_category", "category").alias("product_category"),
        F.when(q > 2, "in_stock").otherwise("low_stock").alias("stock_status"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Category file with nested sub-categories to one row per sub-category."""
    df = spark.read.option("multiLine", True).schema("id string, name string, subcategories array<struct<id:string,label:string>>").json(path)
    return explode_taxonomy(df)


def explode_taxonomy(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("category_id"), F.col("name").alias("category"), F.explode_outer("subcategories").alias("s")).select(
        "category_id", "category", F.col("s.id").alias("sub_category_id"), F.col("s.label").alias("sub_category"))


MANIFEST = ("struct<cases:array<struct<id:string,category:string,sub_category:string,image:string,expected_facing_count:int,"
            "facings:array<struct<id:string,brand:string,product_name:string,ocr_label:string,box:array<double>>>>>>")


def manifest_facings(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """Benchmark manifests (one JSON text per row) to one row per labelled facing."""
    m = manifests.select(F.explode(F.from_json(column, MANIFEST)["cases"]).alias("c"))
    return m.select(F.col("c.id").alias("case_id"), F.col("c.category").alias("category"), F.col("c.expected_facing_count").alias("expected_facing_count"), F.posexplode_outer("c.facings").alias("pos", "f")).select(
        "case_id", "category", "expected_facing_count", "pos", "f.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Latest version per key wins; one aggregation over both tables."""
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")
