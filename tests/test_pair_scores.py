"""Rows of a scan meet on the scan, shuffled once; scans too large for that meet on block keys, with the same pairs."""

from __future__ import annotations

import random
import re

import pytest

from shelfwright.operators import planogram_match as PM

BOTH = "scan_id bigint, pos bigint, brand string, product_name string, variant string, sku string, sub_category string, "


@pytest.fixture(scope="module")
def shelves(spark):
    r = random.Random(4)
    brands, products, variants = ["Lays", "Lays Max", "Bingo", "Unknown", None, ""], ["Chips", "Chips Big", "Wafers", "UNVERIFIABLE", None], ["Tomato Tango", "Cream & Onion 50", "Salted", None, ""]
    row = lambda i: (i % 3, i, r.choice(brands), r.choice(products), r.choice(variants), r.choice(["", "SKU-1", "SKU-2", None]), r.choice(["chips", "", None]))
    status = lambda: r.choice(["IDENTIFIED", "UNVERIFIABLE", None])
    cv = [(*row(i), "Snacks", status(), status(), status(), r.choice([None, "A-1?", "A-11"])) for i in range(60)]
    plan = [(*row(i), r.choice(["A-11", "A-12", ""])) for i in range(60)]
    return (spark.createDataFrame(cv, BOTH + "category string, brand_status string, product_status string, variant_status string, location_label string"),
            spark.createDataFrame(plan, BOTH + "location string"))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("limit", [0, 39])
def test_large_scans_have_the_same_pairs(shelves, limit):
    want = rows(PM.scored_pairs(*shelves))
    assert len(want) > 100 and rows(PM.scored_pairs(*shelves, limit=limit)) == want


def test_large_scans_have_the_same_words(shelves):
    planned = PM.planned_features(shelves[1])
    want = rows(PM.distinctive_words(planned))
    assert want and rows(PM.distinctive_words(planned, limit=0)) == want


def test_no_pair_is_shuffled(shelves):
    plan = PM.scored_pairs(*PM.prepare(*shelves))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert len(keys) == 2 and all(re.fullmatch(r"scan_id#\d+L", k) for k in keys)
