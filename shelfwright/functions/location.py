"""Shelf-edge labels and visible prices: normal form, wildcard equality, status ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts that mean "no label".
LABEL_PLACEHOLDERS = ["", "null", "none", "n/a", "na", "-", "—", "unverifiable", "not visible"]


def normalize_label(col: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(col.cast("string"), F.lit(""))))
    tight = F.regexp_replace(F.regexp_replace(text, r"\s*-\s*", "-"), r"\s+", "")
    return F.when(F.lower(text).isin(LABEL_PLACEHOLDERS), F.lit("")).when(text.rlike(r"\s"), tight).otherwise(text)


def normalize_rack(col: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(~F.lower(text).isin(LABEL_PLACEHOLDERS), text)


def fits(read: Column, full: Column) -> Column:
    """Normalised label ``read`` equals ``full``; '?' in the read label stands for any character."""
    chars = F.zip_with(F.split(read, ""), F.split(full, ""), lambda x, y: (x == "?") | (x == y))
    wild = read.contains("?") & (F.length(read) == F.length(full)) & F.forall(chars, lambda ok: ok)
    return (read != "") & (full != "") & ((read == full) | wild)


def compatible(a: Column, b: Column) -> Column:
    """Two read labels may be the same physical one ('?' unknown on either side)."""
    chars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) | (x == "?") | (y == "?"))
    wild = (a.contains("?") | b.contains("?")) & (F.length(a) == F.length(b)) & F.forall(chars, lambda ok: ok)
    return (a == b) | wild


def visible_price(col: Column) -> Column:
    """First number in the text, thousands commas dropped; only positive prices count."""
    num = F.regexp_extract(F.replace(col.cast("string"), F.lit(","), F.lit("")), r"\d+(?:[.]\d+)?", 0)
    price = F.nullif(num, F.lit("")).try_cast("double")
    return F.when(price > 0, price)


def location_status(expected: Column, actual: Column, labels: Column, ambiguous: Column) -> Column:
    """Status of a row against the labels read in its photo (arrays of normalised labels)."""
    exp = normalize_label(expected)
    raw = normalize_label(actual)
    act = F.when(F.array_contains(ambiguous, raw), F.lit("")).otherwise(raw)
    any_fit = F.exists(labels, lambda x: fits(x, exp))
    full_fit = F.exists(labels, lambda x: ~x.contains("?") & (x == exp))
    return (
        F.when(exp == "", "NO_EXPECTED")
        .when(fits(act, exp), F.when(act.contains("?"), "NOT_READABLE").otherwise("CORRECT"))
        .when(~any_fit, "EXPECTED_NOT_IN_PHOTO")
        .when((act == "") | act.contains("?") | ~full_fit, "NOT_READABLE")
        .otherwise("WRONG_LOCATION")
    )


def price_status(expected: Column, visible: Column) -> Column:
    return price_state(visible_price(expected), visible_price(visible))


def price_state(e: Column, a: Column) -> Column:
    """``price_status`` of two prices as numbers."""
    return (
        F.when(e.isNull(), "NO_EXPECTED").when(a.isNull(), "NOT_READABLE")
        .when(F.bround(a, 2) == F.bround(e, 2), "MATCH").otherwise("MISMATCH")
    )


# A marked price first, then a bare 2–5 digit number; range in rupees.
MARKED_PRICE = r"(?i)(?:mrp|rs\.?|₹|inr|price)\s*[:\-]?\s*(\d{1,6}(?:\.\d{1,2})?)"
BARE_PRICE = r"\b(\d{2,5})\b"
PRICE_RANGE = (5, 50000)


def price_in_text(col: Column) -> Column:
    text = F.regexp_replace(F.trim(col), ",", "")

    def pick(pattern: str) -> Column:
        v = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
        return F.when(v.between(*PRICE_RANGE), v)

    return F.coalesce(pick(MARKED_PRICE), pick(BARE_PRICE))
