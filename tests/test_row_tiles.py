"""Labels from shelf rows: many vectors lie in tiles, few are joined; rows without an unlabelled facing are left out; shelf rows need one shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import boxes as B
from shelfwright.operators import row_labels as RL


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(7)
    facings = [(n // 40, n % 40 // 10, n, r.randrange(60) if n % 10 < 8 else 900, None if n % 10 == 0 and n % 3 else r.choice(["a", "b"]), r.choice([0.5, 0.9]), r.choice(["", "a x", "the b"])) for n in range(400)]
    vectors = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    return (spark.createDataFrame(facings, "scan_id long, row_idx long, pos long, vid long, brand string, confidence double, pack_text string"),
            spark.createDataFrame(vectors, "id long, vec array<float>"))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_tiles_give_the_same_pairs(tables, monkeypatch):
    facings, vectors = tables
    want = rows(RL.similar_in_row(facings, vectors, 0.3))
    monkeypatch.setattr(RL, "VECTOR_TILE", 16)
    assert want and rows(RL.similar_in_row(facings, vectors, 0.3, few=0)) == want
    monkeypatch.setattr(RL, "TILE_PAIRS", 16)
    assert rows(RL.similar_in_row(facings, vectors, 0.3, few=0)) == want
    odd = vectors.unionByName(vectors.limit(1).select(F.lit(900).cast("long").alias("id"), F.array(F.lit(1.0).cast("float")).alias("vec")))
    assert rows(RL.similar_in_row(facings, odd, 0.3, few=0)) == want  # vectors of several lengths are joined


def test_no_vector_goes_with_a_pack(tables):
    facings, vectors = tables
    plan = RL.similar_in_row(facings, vectors, 0.3, few=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_rows_without_an_unlabelled_facing_are_left_out(tables):
    facings, _ = tables
    kept = {(x.scan_id, x.row_idx) for x in RL.open_rows(facings).collect()}
    assert kept == {(x.scan_id, x.row_idx) for x in facings.where("brand IS NULL").collect()} and len(kept) < 40


def test_shelf_rows(spark):
    r = random.Random(3)
    boxes = [(n % 7, n, y, y + r.choice([0, 30, 90])) for n in range(300) for y in [r.choice([0, 150, 300]) + r.randint(0, 60)]]
    df = spark.createDataFrame([*boxes, (1, 900, None, 5), (None, 901, 1, 9), (8, 902, 5, 5)], "scan_id long, pos long, y1 int, y2 int")
    got = B.shelf_rows(df)
    assert rows(got) == rows(B.shelf_rows(df, limit=1)) == rows(B.shelf_rows(df, limit=0)) and got.count() == 301
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
