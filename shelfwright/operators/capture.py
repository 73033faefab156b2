"""Count verification, unit cap, states, label fixes and photo merge of raw scan rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import keys as K

TOLERANCE_UNITS, TOLERANCE_FRACTION = 2, 0.03

# Wordmark misreads of one chip brand and the flavours that give it away.
CHIP_BRAND_MISREADS = ["louis", "loui's", "loui", "lou is", "lay", "lays", "lay s", "lay5", "lay's"]
CHIP_FLAVOURS = (
    r"magic\s+masala|tangy\s+tomato|tomato\s+tango|cream\s*(?:&|and)\s*onion|classic\s+salted|"
    r"west\s*indies\s+hot\s*[n&]\s*sweet\s+chilli|spanish\s+tomato\s+tango"
)
CHIP_PRODUCT = r"\b(chips?|potato\s+chips?|crisps?)\b"
BRAND_GAPS = ["", "unverifiable", "unknown", "unidentified", "n/a", "na", "none", "null", "-", "—"]


def cap_units(products: DataFrame) -> DataFrame:
    """Units fully in view can not exceed facings; the raw value stays beside the capped one."""
    f, u = F.col("actual_facings"), F.col("actual_visible_units")
    capped = F.coalesce((f > 0) & (u > f), F.lit(False))
    return products.withColumns({
        "raw_visible_units": u, "actual_visible_units": F.when(capped, f).otherwise(u), "capped": capped})


def _check(total: Column, any_countable: Column, n_rows: Column, summary: Column) -> dict[str, Column]:
    product_sum = F.when(n_rows == 0, F.lit(0)).when(any_countable, total)
    gap = F.abs(product_sum - summary)
    tolerance = F.greatest(F.lit(TOLERANCE_UNITS), F.ceil(F.lit(TOLERANCE_FRACTION) * F.greatest(product_sum, summary)))
    status = (
        F.when(product_sum.isNull() & summary.isNull(), "UNAVAILABLE")
        .when(product_sum.isNull() | summary.isNull(), "COUNT_MISMATCH")
        .when(gap == 0, "VERIFIED").when(gap <= tolerance, "APPROXIMATE").otherwise("COUNT_MISMATCH"))
    return {"sum": product_sum, "status": status, "verified": F.when(status.isin("VERIFIED", "APPROXIMATE"), product_sum)}


def verify_counts(products: DataFrame, summaries: DataFrame) -> DataFrame:
    """Row sums against the totals the reader reported, with a small tolerance.

    ``summaries`` = (scan_id, total_facings, total_units) as stated by the payload.
    """
    agg = products.groupBy("scan_id").agg(
        F.count("*").alias("n"), F.count("actual_facings").alias("nf"), F.count("actual_visible_units").alias("nu"),
        F.sum(F.when(F.col("actual_facings") > 0, F.col("actual_facings")).otherwise(0)).alias("f"),
        F.sum(F.when(F.col("actual_visible_units") > 0, F.col("actual_visible_units")).otherwise(0)).alias("u"))
    both = summaries.join(agg, "scan_id", "left").na.fill(0, ["n", "nf", "nu", "f", "u"])
    fc = _check(F.col("f"), F.col("nf") > 0, F.col("n"), F.col("total_facings"))
    uc = _check(F.col("u"), F.col("nu") > 0, F.col("n"), F.col("total_units"))
    out = both.select(
        "scan_id", fc["sum"].alias("facings_sum"), fc["status"].alias("facings_status"), fc["verified"].alias("facings_verified"),
        uc["sum"].alias("units_sum"), uc["status"].alias("units_status"), uc["verified"].alias("units_verified"))
    fs, us = F.col("facings_status"), F.col("units_status")
    mismatch = (fs == "COUNT_MISMATCH") | (us == "COUNT_MISMATCH")
    return out.withColumn("scan_status", F.when(mismatch, "COUNT_MISMATCH").when(
        (fs == "APPROXIMATE") | (us == "APPROXIMATE"), "APPROXIMATE").otherwise("VERIFIED")).withColumn(
        "scan_complete", ~mismatch)


def withhold_incomplete(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Totals of a scan whose counts disagree are withheld, not shown as numbers."""
    ok = F.col("scan_complete")
    return metrics.select(
        "scan_id", *[F.when(ok, F.col(c)).alias(c) for c in columns],
        *[F.when(~ok, "COUNT_MISMATCH").when(F.col(c).isNull(), "UNAVAILABLE").otherwise("CALCULATED").alias(f"{c}_status")
          for c in columns])


def fix_brand_by_neighbour(rows: DataFrame, misread: str, anchor: str, label: str) -> DataFrame:
    """A misread brand takes the anchor's name when the anchor is on the same shelf."""
    b = F.lower(F.trim(F.coalesce("brand", F.lit(""))))
    anchors = rows.where(b == anchor).select("scan_id").distinct().withColumn("has_anchor", F.lit(True))
    out = rows.join(anchors, "scan_id", "left")
    hit = (b == misread) & F.col("has_anchor").isNotNull()
    return out.withColumns({
        "brand": F.when(hit, label).otherwise(F.col("brand")),
        "pack_text": F.when(hit, F.regexp_replace("pack_text", rf"(?i)\b{misread}\b", label)).otherwise(F.col("pack_text")),
    }).drop("has_anchor")


def canonical_chip_brand(rows: DataFrame) -> DataFrame:
    """Chip-brand misreads and unread brands with a telling flavour become the brand itself."""
    b, v, p = K.squash(F.col("brand")), K.squash(F.col("variant")), K.squash(F.col("product_name"))
    flavour, chips = v.rlike(CHIP_FLAVOURS), p.rlike(CHIP_PRODUCT)
    misread = b.isin(CHIP_BRAND_MISREADS)
    first, second = misread & (flavour | chips), flavour & b.isin(BRAND_GAPS)
    status = K.squash(F.col("brand_status"))
    return rows.withColumns({
        "brand": F.when(first | second, "Lay's").otherwise(F.col("brand")),
        "brand_status": F.when(second | (first & status.isin(BRAND_GAPS)), "IDENTIFIED").otherwise(F.col("brand_status")),
    })


# States a metric may carry.
METRIC_STATES = ["available", "calculated", "estimated", "not_configured", "insufficient_evidence", "not_applicable", "unavailable"]


def merge_states(computed: DataFrame, external: DataFrame) -> DataFrame:
    """A computed value wins; an external state only fills in where no value was computed."""
    j = computed.join(external.select("scan_id", "metric_id", F.col("state").alias("xs"), F.col("label").alias("xl")),
                      ["scan_id", "metric_id"], "left")
    ok = F.col("xs").isin(METRIC_STATES)
    state = (
        F.when(ok & F.col("value").isNull() & ~F.col("xs").isin("available", "calculated"), F.col("xs"))
        .when(ok & F.col("value").isNotNull(), F.when(F.col("xs") == "calculated", "available").otherwise(F.coalesce("state", F.lit("available"))))
        .otherwise(F.col("state")))
    return j.select("scan_id", "metric_id", "value", state.alias("state"),
                    F.coalesce(F.nullif("label", F.lit("")), "xl").alias("label"))


# Image quality ranks; the weakest photo decides for the scan.
QUALITY_RANK = {"GOOD": 0, "LIMITED": 1, "POOR": 2}


def merge_photos(photos: DataFrame, labels: DataFrame) -> DataFrame:
    """One payload per scan: totals only when every photo states them, weakest quality, distinct labels.

    ``photos`` = (scan_id, photo, total_facings, quality); ``labels`` = (scan_id, photo, label).
    """
    q = F.upper(F.trim(F.coalesce("quality", F.lit(""))))
    rank = F.create_map(*[F.lit(x) for kv in QUALITY_RANK.items() for x in kv])[q]
    p = photos.groupBy("scan_id").agg(
        F.count("*").alias("photos"),
        F.when(F.count("total_facings") == F.count("*"), F.sum("total_facings")).alias("total_facings"),
        F.max_by(q, rank).alias("quality"))
    distinct = labels.where(F.trim("label") != "").groupBy("scan_id", F.lower(F.trim("label")).alias("k")).agg(
        F.min("photo").alias("photo"))
    n = distinct.groupBy("scan_id").agg(F.count("*").alias("labels"))
    return p.join(n, "scan_id", "left").select(
        "scan_id", "photos", "total_facings", "quality", F.coalesce("labels", F.lit(0)).alias("labels"))


def _norm(col: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit(""))))


def merged_lists(products: DataFrame, labels: DataFrame) -> DataFrame:
    """Union of the lists of a scan's photos: (scan_id, list, photo, entry).

    Products are all kept, each with its photo. Of location labels that are equal but for case and outer blanks the first photo's stays;
    blank ones are no duplicates of each other. ``products`` = (scan_id, photo, entry), ``labels`` = (scan_id, photo, label).
    """
    named = labels.where(_norm("label") != "").groupBy("scan_id", _norm("label").alias("k")).agg(F.min(F.struct("photo", "label")).alias("m")).select("scan_id", "m.*")
    every = named.unionByName(labels.where(_norm("label") == "").select("scan_id", "photo", "label"))
    return products.select("scan_id", F.lit("products").alias("list"), "photo", "entry").unionByName(
        every.select("scan_id", F.lit("location_labels").alias("list"), "photo", F.col("label").alias("entry")))


def merged_summary(photos: DataFrame, products: DataFrame) -> DataFrame:
    """Counts of a merged scan: distinct products, brands and categories, facings of each photo in order and their sum.

    A product counts once per brand, product and variant without regard to case; rows that name none of them do not count. Photos
    without products have no facings; unknown and negative facings count as none.
    """
    key = F.concat_ws("|", _norm("brand"), _norm("product_name"), _norm("variant"))
    distinct = products.groupBy("scan_id").agg(
        F.count_distinct(F.when(key != "||", key)).alias("products_detected"), F.count_distinct(F.nullif(_norm("brand"), F.lit(""))).alias("brands_detected"),
        F.count_distinct(F.nullif(_norm("category"), F.lit(""))).alias("categories_detected"))
    seen = products.groupBy("scan_id", "photo").agg(F.sum(F.greatest(F.lit(0), F.coalesce("actual_facings", F.lit(0)))).alias("n"))
    per = photos.select("scan_id", "photo").distinct().join(seen, ["scan_id", "photo"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = per.groupBy("scan_id").agg(F.count("*").alias("photo_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("photo", "n"))), lambda x: x["n"].cast("string")), ",").alias("facings_per_photo"),
                                     F.sum("n").alias("merged_facings")).join(distinct, "scan_id", "left")
    return out.select("scan_id", "photo_count", "facings_per_photo", "merged_facings", *[F.coalesce(c, F.lit(0)).alias(c) for c in distinct.columns[1:]])
