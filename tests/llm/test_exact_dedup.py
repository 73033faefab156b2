"""Exact duplicates against a plain grouping."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shelfwright.llm import exact_dedup


def plain(rows):
    by = collections.defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (d, _), n in zip(rows, norm, strict=True):
        by[n].append(d)
    out = []
    for (d, _), n in zip(rows, norm, strict=True):
        ids = [x for x in by[n] if x is not None]
        low = min(ids) if ids else None
        out.append((d, low, len(by[n]), d == low, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of():
    long = "x y\t\nz " * 400_000
    rows = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, " a b"), (5, "a b "), (6, None), (7, ""), (8, " "), (9, "\n\n"), (10, "A b"), (11, "a b"), (12, "é é"), (13, "é é"),
            (14, long), (15, long.replace("\t\n", " ")), (16, long + "."), (20, "again"), (20, "again"), (20, "other"), (None, "a b"), (None, "nobody"), (None, "nobody"), (21, "a\x0bb"), (-5, "a \r\n b"), (30, "a\x1cb")]
    return rows + [(i, "hot  text" if i % 2 else "hot\ttext") for i in range(100, 400)]


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_groups(spark, parts):
    rows = rows_of()
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, salt int, digest string, content int").repartition(parts)
    assert got(exact_dedup.groups(docs)) == plain(rows)
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns
    want = {(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for (d, t) in rows}
    firsts = collections.Counter((r[0], r[4]) for r in plain(rows) if r[3])
    assert sorted(((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in stay.collect()), key=repr) == sorted(firsts, key=repr) and want


def test_content_decides_where_digests_clash(spark):
    """With a digest of two values every stage still compares the contents."""
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact_dedup.groups(docs, digest=lambda c: (F.octet_length(c) % 2).cast("string"))
    assert [r[:4] for r in got(weak)] == [r[:4] for r in plain(rows)]


def test_empty_and_native(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    assert exact_dedup.groups(docs.limit(0)).count() == 0 and exact_dedup.deduplicated(docs.limit(0)).count() == 0
    plan = exact_dedup.groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
