"""Text expressions: noise clean-up, tokens, error rate, fuzzy equality."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright.functions.keys import let, squash


def clean_read_text(col: Column) -> Column:
    """Lower-cased pack text with common misreads repaired and letter runs squeezed to two."""
    t = squash(col)
    # Misread patterns and their repair, in order.
    for pattern, repl in (
        (r"(?i)\b0(?=[a-z])", "O"), (r"(?i)(?<=[a-z])0(?=\s|$)", "o"), (r"(?i)\bl\s*'?\s*s\b", "lays"), (r"\b1(?=[a-z])", "l"),
        (r"(.)\1{2,}", "$1$1"), (r"\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, repl)
    return F.trim(t)


def volume_tokens(col: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(col), F.lit(r"(\b\d+\s*ml\b)"), 1), lambda v: F.replace(v, F.lit(" "), F.lit(""))))


def slug(*parts: Column) -> Column:
    raw = F.regexp_replace(F.lower(F.concat_ws("_", *parts)), r"[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(raw, r"^_+|_+$", ""), 1, 120)


def shelf_number(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"(?i)shelf\s*(\d+)", 1), F.lit("")).try_cast("int")


def error_rate(expected: Column, actual: Column) -> Column:
    """Edit distance over the expected length; an empty expectation is met only by an empty text."""
    e, a = squash(expected), squash(actual)
    return F.when(e == "", F.when(a == "", 0.0).otherwise(1.0)).when(a == "", 1.0).otherwise(F.levenshtein(e, a) / F.length(e))


def brand_equal(expected: Column, actual: Column) -> Column:
    e, a = squash(expected), squash(actual)
    ek, ak = F.regexp_replace(e, "[^a-z0-9]", ""), F.regexp_replace(a, "[^a-z0-9]", "")
    return (e == "") | a.contains(e) | e.contains(a) | ((ek != "") & ak.contains(ek))


def product_equal(expected: Column, actual: Column) -> Column:
    e, a = squash(expected), squash(actual)
    et = F.array_distinct(F.split(e, " "))
    recall = F.size(F.array_intersect(et, F.split(a, " "))) / F.size(et)
    return (e == "") | a.contains(e) | e.contains(a) | (recall >= 0.5)


def sku_equal(expected: Column, actual: Column) -> Column:
    e, a = F.replace(squash(expected), F.lit(" "), F.lit("_")), F.replace(squash(actual), F.lit(" "), F.lit("_"))
    return (e == "") | a.contains(e) | e.contains(a)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length (stands in for a sequence-matcher ratio)."""
    return F.when((F.length(a) > 0) | (F.length(b) > 0), 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(1.0)


def token_hits(text: Column, token: str) -> Column:
    """A rule token in normalised text; tokens of up to four letters only as whole words."""
    if " " in token or len(token) > 4:
        return text.contains(token)
    return text.rlike(rf"(?U)\b{re.escape(token)}\b")


def first_rule(text: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """Value of the first rule with a token in the text."""
    def ladder(t: Column) -> Column:
        out = F.lit(default)
        for tokens, value in reversed(rules):
            hit = F.lit(False)
            for tok in tokens:
                hit = hit | token_hits(t, tok)
            out = F.when(hit, value).otherwise(out)
        return out
    return let(squash(text), ladder)
