"""Row validation of planogram, assortment, price and promotion tables, with error lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import keys as K


def text(name: str) -> Column:
    """Trimmed text with one space for each run of white space; only runs that are not one space already match."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), r"\s{2,}|[^\S ]", " "))


def blank(name: str) -> Column:
    """``text(name)`` is empty: null, or no character but white space."""
    return ~F.coalesce(F.col(name).cast("string").rlike(r"\S"), F.lit(False))


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)) for bad, msg in checks]))


def _given(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def _number_checks(names: list[str], kind: str) -> list[tuple[Column, str]]:
    out = []
    for n in names:
        v = F.col(n).cast("string").try_cast(kind)
        out += [(_given(n) & v.isNull(), f"{n} must be a number"), (v < 0, f"{n} must be >= 0")]
    return out


def planogram_rows(raw: DataFrame) -> DataFrame:
    """All-string planogram rows to typed rows with ``errors``; a row is valid when the list is empty."""
    required = [(blank(n), f"{n} is required") for n in ("location", "brand", "product_name", "category", "sub_category")]
    counts = ["expected_facings", "min_facings", "max_facings", "expected_shelf_units", "expected_qty"]
    num = lambda n, k="int": F.nullif(F.col(n).cast("string"), F.lit("")).try_cast(k)
    err = _errors(*required, *_number_checks(counts, "int"),
                  (~_given("expected_facings") & ~_given("expected_qty"), "expected_facings or expected_qty is required"),
                  (num("min_facings") > num("max_facings"), "min_facings cannot exceed max_facings"),
                  *_number_checks(["mrp_inr", "avg_daily_sales"], "double"))
    typed = raw.withColumn("errors", err)
    return typed.withColumns({
        **{n: num(n) for n in counts if n != "expected_qty"},
        "expected_qty": F.coalesce(num("expected_qty"), num("expected_facings"), F.lit(0)),
        "mrp_inr": F.bround(num("mrp_inr", "double"), 2), "avg_daily_sales": F.bround(num("avg_daily_sales", "double"), 2),
        "match_key": K.match_key(text("brand"), text("product_name"), text("sku"), text("sub_category"), text("variant")),
    })


def assortment_rows(raw: DataFrame) -> DataFrame:
    kind = F.lower(text("list_type"))
    err = _errors((text("sku") == "", "sku is required"), (~kind.isin("mandatory_assortment", "msl", "optional"), "list_type must be mandatory_assortment, msl, or optional"))
    return raw.select("row_no", text("sku").alias("sku"), kind.alias("list_type"), F.coalesce(F.nullif(text("outlet_scope"), F.lit("")), F.lit("all")).alias("outlet_scope"),
                      F.lower(text("substitution_allowed")).isin("true", "1", "yes").alias("substitution_allowed"), (kind == "optional").alias("optional"), err.alias("errors"))


def price_rows(raw: DataFrame) -> DataFrame:
    p = F.col("expected_price").cast("string").try_cast("double")
    err = _errors((text("sku") == "", "sku is required"), (p.isNull(), "expected_price must be a number"), (p < 0, "expected_price must be >= 0"))
    return raw.select("row_no", text("sku").alias("sku"), F.coalesce(F.nullif(text("label_location"), F.lit("")), F.lit("shelf_tag")).alias("label_location"),
                      F.bround(p, 2).alias("expected_price"), F.coalesce(F.nullif(text("currency"), F.lit("")), F.lit("INR")).alias("currency"), err.alias("errors"))


def promotion_rows(raw: DataFrame) -> DataFrame:
    f = F.col("required_facings").cast("string").try_cast("int")
    p = F.col("expected_promo_price").cast("string").try_cast("double")
    err = _errors((text("promotion_id") == "", "promotion_id is required"), (text("participating_skus") == "", "participating_skus is required"),
                  (_given("required_facings") & f.isNull(), "required_facings must be a number"), (_given("expected_promo_price") & p.isNull(), "expected_promo_price must be a number"))
    skus = F.filter(F.transform(F.split("participating_skus", r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    return raw.select("row_no", text("promotion_id").alias("promotion_id"), skus.alias("participating_skus"), F.bround(p, 2).alias("expected_promo_price"),
                      F.when(f.isNotNull(), F.greatest(F.lit(0), f)).alias("required_facings"), err.alias("errors"))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def validation_summary(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.size("errors") == 0).alias("valid_count"), F.sum(F.size("errors")).alias("error_count"))
