"""Document tables: header detection, header carry-over to continuation pages, invoice items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that mark a header row.
HEADER_WORDS = r"(?i)\b(item|product|description|sku|qty|quantity|price|rate|amount|mrp|brand|unit|total|code|name)\b"
NUMERIC = r"^[\s₹$€]*-?[0-9][0-9.,]*%?\s*$"


def looks_like_header(cells: Column) -> Column:
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    return (F.size(filled) >= 2) & ~F.exists(filled, lambda c: c.rlike(NUMERIC)) & F.exists(filled, lambda c: c.rlike(HEADER_WORDS))


def normalize_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, page, row, cells) to data rows under their header; later pages reuse an earlier one.

    A header is looked for in the first five rows of a page. A document's rows are few by nature; the
    carry-forward runs over its header rows only, found by a window on pages, and is joined back.
    """
    rows = cells.where(F.exists("cells", lambda c: F.trim(c) != ""))
    head = rows.where((F.col("row") < 5) & looks_like_header(F.col("cells"))).groupBy("doc_id", "page").agg(F.min_by(F.struct("row", "cells"), "row").alias("h"))
    pages = rows.groupBy("doc_id", "page").agg(F.max(F.size("cells")).alias("width")).join(head, ["doc_id", "page"], "left")
    w = Window.partitionBy("doc_id").orderBy("page")
    names = F.transform(F.coalesce("h.cells", F.last("h.cells", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))), lambda c, i: F.coalesce(
        F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string"))))
    plain = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    hdr = pages.withColumn("carried", names).select(
        "doc_id", "page", F.col("h.row").alias("head_row"),
        F.when(F.col("h").isNotNull() | (F.size("carried") == F.col("width")), F.col("carried")).otherwise(plain).alias("header"))
    j = rows.join(hdr, ["doc_id", "page"]).where(F.col("head_row").isNull() | (F.col("row") > F.col("head_row")))
    n = F.size("header")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), n)), F.lit(1), n)
    return j.select("doc_id", "page", "row", "header", padded.alias("cells"))


INVOICE = ("struct<documents:array<struct<vendor:string,customer:string,invoice_id:string,total:double,currency:string,"
           "items:array<struct<page:int,description:string,quantity:double,amount:double,confidence:double>>>>>")


def invoice_items(results: DataFrame) -> DataFrame:
    """Invoice analysis JSON (doc_id, result) to item rows by page."""
    d = results.select("doc_id", F.posexplode(F.from_json("result", INVOICE)["documents"]).alias("part", "d"))
    return d.select("doc_id", "part", F.posexplode("d.items").alias("pos", "i")).where(
        "coalesce(i.description, '') <> '' OR i.quantity IS NOT NULL OR i.amount IS NOT NULL").select("doc_id", "part", "pos", F.coalesce("i.page", F.lit(1)).alias("page"), "i.description", "i.quantity", "i.amount")


def invoice_meta(results: DataFrame) -> DataFrame:
    """First stated names and the sum of totals over the parts of a document."""
    d = results.select("doc_id", F.posexplode(F.from_json("result", INVOICE)["documents"]).alias("part", "d"))
    first = lambda n: F.min_by(F.col(f"d.{n}"), F.when(F.coalesce(F.col(f"d.{n}"), F.lit("")) != "", F.col("part"))).alias(n)
    return d.groupBy("doc_id").agg(first("vendor"), first("customer"), first("invoice_id"), F.sum(F.col("d.total").cast("decimal(24,2)")).cast("double").alias("total"))
