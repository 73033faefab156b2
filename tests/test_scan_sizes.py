"""Small scans are compared directly or read by one task, larger ones go through cells and rounds; both give the same rows, in few jobs."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import boxes as B
from shelfwright.operators import matching as MT


@pytest.fixture(scope="module")
def boxes(spark):
    r = random.Random(8)
    rows = []
    for n in range(240):
        x, y = r.randint(0, 500), r.choice([0, 150, 300]) + r.randint(0, 40)
        rows.append((n % 6, n, x, y, x + r.randint(10, 120), y + r.randint(10, 170), r.random(), r.choice(["a", "b", None]), 1 + n // 6 % 2))
    rows += [(6, 900, None, 10, 50, 60, 0.5, "a", 1), (6, 901, 10, 10, 50, 60, 0.5, "a", 1), (7, 902, 10, 10, 10, 60, 0.5, "a", 2)]
    return spark.createDataFrame(rows, "scan_id bigint, pos bigint, x1 int, y1 int, x2 int, y2 int, confidence double, key string, photo int")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("limit", [0, 39])
def test_overlaps(boxes, limit):
    side = boxes.where("pos < 900").select("scan_id", "pos", "x1", "y1", "x2", "y2")
    assert rows(MT.overlap_pairs(side, side, "scan_id")) == rows(MT.overlap_pairs(side, side, "scan_id", limit=limit))


def test_merged_columns(boxes):
    got = rows(B.merge_columns(boxes))
    assert len(got) < boxes.count() and got == rows(B.merge_columns(boxes, limit=1))


def test_merged_photos(boxes):
    got = rows(B.merge_photos(boxes, iou=0.2))
    assert len(got) < boxes.count() and got == rows(B.merge_photos(boxes, iou=0.2, limit=1))


@pytest.mark.parametrize("run", [B.merge_columns, B.merge_photos])
def test_small_scans_need_few_jobs(spark, boxes, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "jobs of one call")
    try:
        run(boxes.where(F.col("pos") < 900)).write.format("noop").mode("overwrite").save()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 12
