"""Queries that need the base rows in many places read the given tables a few times only."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from shelfwright.plans.domain import Domain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g23_role_dashboards", "t4_opportunity_ledger"])
def test_base_is_read_once(spark, name):
    assert not any("lineitem.parquet" in f or "/part.parquet" in f for f in entry.queries()[name](spark, SF).inputFiles())


def test_written_tables_are_the_same(spark):
    d = Domain(spark, SF)
    w = d.written()
    for name in ("base", "inv", "lines", "plan", "cv", "fac", "prows"):
        a, b = getattr(d, name), getattr(w, name)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name
