"""Location roll-up by shelf-edge label, ambiguous partial labels, row annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import keys as K
from shelfwright.functions import location as L
from shelfwright.session import cut_lineage


def _label_status(status: Column, label: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(label.contains("?"), "PARTIAL").when(s.isin("READ", "PARTIAL"), s).otherwise("READ")


def label_rollup(products: DataFrame, read_labels: DataFrame | None = None) -> DataFrame:
    """One row per label of a scan: distinct products, facings, units; empty when no product has it.

    ``read_labels`` = (scan_id, pos, label, rack_marker, status) for labels without a product;
    their ``pos`` follows the products of the scan.
    """
    ident = F.concat_ws("|", K.squash(F.col("brand")), K.squash(F.col("product_name")), K.squash(F.col("variant")))
    label = L.normalize_label(F.col("location_label"))
    status = F.col("location_label_status") if "location_label_status" in products.columns else F.lit(None).cast("string")
    rows = products.select(
        "scan_id", "pos", label.alias("label"), L.normalize_rack(F.col("rack_marker")).alias("rack"),
        _label_status(status, label).alias("status"), ident.alias("ident"),
        F.greatest(F.coalesce("actual_facings", F.lit(0)), F.lit(0)).alias("f"),
        F.greatest(F.coalesce("actual_visible_units", F.lit(0)), F.lit(0)).alias("u"))
    if read_labels is not None:
        norm = L.normalize_label(F.col("label"))
        extra = read_labels.select(
            "scan_id", "pos", norm.alias("label"), L.normalize_rack(F.col("rack_marker")).alias("rack"),
            _label_status(F.col("status"), norm).alias("status"), F.lit(None).cast("string").alias("ident"),
            F.lit(0).alias("f"), F.lit(0).alias("u"))
        rows = rows.unionByName(extra)
    return rows.where(F.col("label") != "").groupBy("scan_id", "label").agg(
        F.min_by("rack", F.when(F.col("rack").isNotNull(), F.col("pos"))).alias("rack_marker"),
        F.min_by("status", "pos").alias("label_status"), F.count_distinct("ident").alias("products"),
        F.count("ident").alias("n_rows"), F.sum("f").alias("facings"), F.sum("u").alias("visible_units"))


def ambiguous_labels(labels: DataFrame) -> DataFrame:
    """Partial labels that fit two or more other labels of the scan.

    ``labels`` holds the distinct labels of a scan. A partial label is joined only with labels of
    its own length and of the same known leading part, and counted without listing the pairs.
    """
    keyed = labels.select("scan_id", "label", F.length("label").alias("n"),
                          F.substring_index("label", "?", 1).alias("head"))
    part = keyed.where(F.col("label").contains("?")).select("scan_id", "n", F.col("label").alias("part"), F.col("head").alias("ph"))
    hit = part.join(keyed, ["scan_id", "n"]).where(
        (F.col("part") != F.col("label")) & L.compatible(F.col("part"), F.col("label")))
    return hit.groupBy("scan_id", F.col("part").alias("label")).agg(F.count("*").alias("fits")).where("fits >= 2")


def location_metrics(products: DataFrame, read_labels: DataFrame | None = None) -> DataFrame:
    """Labels read, empty labels, racks, rows without a usable label, prices read, per scan."""
    roll = cut_lineage(label_rollup(products, read_labels).select("scan_id", "label", "products", "n_rows"))
    amb = ambiguous_labels(roll)
    flagged = roll.join(amb.select("scan_id", "label", F.lit(True).alias("amb")), ["scan_id", "label"], "left")
    ok = F.col("amb").isNull()
    per_label = flagged.groupBy("scan_id").agg(
        F.count_if(ok).alias("location_labels_read"), F.count_if(ok & (F.col("products") == 0)).alias("empty_locations"),
        F.count_if(~ok).alias("ambiguous_labels"),
        F.sum(F.when(~ok, F.col("n_rows")).otherwise(0)).alias("amb_rows"))
    racks = products.select("scan_id", "rack_marker")
    if read_labels is not None:
        racks = racks.unionByName(read_labels.select("scan_id", "rack_marker"))
    rack = racks.groupBy("scan_id").agg(F.count_distinct(L.normalize_rack(F.col("rack_marker"))).alias("racks_detected"))
    base = products.groupBy("scan_id").agg(
        F.count_if(L.normalize_label(F.col("location_label")) == "").alias("without"),
        F.count(L.visible_price(F.col("visible_price"))).alias("prices_read"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.join(per_label, "scan_id", "left").join(rack, "scan_id", "left").select(
        "scan_id", zero("location_labels_read"), zero("empty_locations"), zero("ambiguous_labels"), zero("racks_detected"),
        (F.col("without") + F.coalesce("amb_rows", F.lit(0))).alias("products_without_location"), "prices_read")


def annotate_rows(rows: DataFrame, roll: DataFrame) -> DataFrame:
    """Location status, price status and price difference of the rows that were seen.

    A row needs at most three facts about its photo: whether its own label is ambiguous and whether
    the expected label was read fully or in part. They come by equi-joins on distinct labels, so no scan
    collects its label list. Labels and the rows' normalised values are written once.
    """
    roll = cut_lineage(roll.select("scan_id", "label"))
    amb = ambiguous_labels(roll)
    good = roll.join(amb.select("scan_id", "label"), ["scan_id", "label"], "left_anti").select("scan_id", "label")
    seen = cut_lineage(rows.where("attached").select("scan_id", "pos", L.normalize_label(F.col("location")).alias("exp"), L.normalize_label(F.col("location_label")).alias("raw"),
                                                     L.visible_price(F.col("mrp_inr")).alias("e"), L.visible_price(F.col("visible_price")).alias("a")))
    yes, no = F.lit(True), F.lit(False)
    full = good.where(~F.col("label").contains("?")).select("scan_id", F.col("label").alias("exp"), yes.alias("full"))
    part = good.where(F.col("label").contains("?")).select("scan_id", F.col("label").alias("p"), F.length("label").alias("n"))
    wanted = seen.select("scan_id", "exp").where("exp <> ''").distinct()
    partial = wanted.withColumn("n", F.length("exp")).join(part, ["scan_id", "n"]).where(L.fits(F.col("p"), F.col("exp"))).select("scan_id", "exp", no.alias("full"))
    read = full.unionByName(partial).groupBy("scan_id", "exp").agg(F.max("full").alias("full_fit"))
    out = seen.join(read, ["scan_id", "exp"], "left").join(amb.select("scan_id", F.col("label").alias("raw"), yes.alias("is_amb")), ["scan_id", "raw"], "left")
    act = F.when(F.col("is_amb"), F.lit("")).otherwise(F.col("raw"))
    full_fit, any_fit = F.coalesce("full_fit", no), F.col("full_fit").isNotNull()
    status = (
        F.when(F.col("exp") == "", "NO_EXPECTED")
        .when(L.fits(act, F.col("exp")), F.when(act.contains("?"), "NOT_READABLE").otherwise("CORRECT"))
        .when(~any_fit, "EXPECTED_NOT_IN_PHOTO")
        .when((act == "") | act.contains("?") | ~full_fit, "NOT_READABLE").otherwise("WRONG_LOCATION"))
    e, a = F.col("e"), F.col("a")
    return out.select(
        "scan_id", "pos", status.alias("location_status"),
        L.price_state(e, a).alias("price_status"),
        F.bround(a - e, 2).alias("price_difference"))
