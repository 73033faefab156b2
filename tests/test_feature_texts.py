"""Features of counted and planned rows: texts are squashed once, words need no interpreted function, and odd texts give the plain rule's words."""

from __future__ import annotations

import re

from shelfwright.operators import planogram_match as PM

CV = "scan_id long, pos long, brand string, product_name string, variant string, sku string, brand_status string, product_status string, variant_status string, category string, sub_category string, location_label string"
TEXTS = [("Lay's", " Potato  Chips", "Cream & Onion"), (None, "", " "), ("Unknown", "N/A", "-"), ("A&B", "x\tY x", "50g x"), ("\tTab", "none such", "India's  Magic Masala")]


def squash(t):
    return re.sub(r"\s+", " ", (t or "").strip(" ").lower())


def plain(*texts):
    text = " ".join(t.replace("'", "").replace("&", " and ") for t in texts)
    return [w for w in dict.fromkeys(re.findall("[a-z0-9]+", text)) if w not in PM.PLACEHOLDERS]


def test_words_and_tokens(spark):
    cv = spark.createDataFrame([(1, n, *t, "", "", "", "", "Snacks", "sub", "") for n, t in enumerate(TEXTS)], CV)
    got = {r.j: r.c for r in PM.counted_features(cv).collect()}
    for n, texts in enumerate(TEXTS):
        own = [squash(t) for t in texts]
        assert got[n].tok == [t for t in dict.fromkeys(" ".join(own).split(" ")) if t and t not in PM.PLACEHOLDERS]
        assert got[n].w == plain(*own, got[n].fk) and got[n].fw == list(dict.fromkeys(got[n].fk.split(" ")))
        assert got[n].ident == "|".join(t.strip(" ").lower() for t in map(lambda x: x or "", texts) if t.strip(" "))
    assert [got[n].fk for n in (0, 1, 4)] == ["cream and onion", "", "magic masala"]


def test_no_interpreted_function(spark):
    cv = spark.createDataFrame([(1, 0, *TEXTS[0], "", "", "", "", "", "", "")], CV)
    for name in ("tok", "w", "ident", "blob", "fk"):
        plan = PM.counted_features(cv).select(f"c.{name}")._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan
