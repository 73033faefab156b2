"""Walks, rounds and spatial joins against brute force on small random inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import boxes as B
from shelfwright.operators import matching as MT
from shelfwright.operators import vectors as V


def sequential(pairs):
    used_l, used_r, out = set(), set(), set()
    for g, o, lt, rt in sorted(pairs):
        if (g, lt) not in used_l and (g, rt) not in used_r:
            used_l.add((g, lt))
            used_r.add((g, rt))
            out.add((g, lt, rt))
    return out


@pytest.mark.parametrize("limit", [10**6, 5, 0])
def test_greedy_agrees_with_sequential_rule(spark, limit):
    rnd = random.Random(limit)
    pairs = [(g, rnd.randint(0, 3), lt, rt) for g in range(4) for lt in range(7) for rt in range(7) if rnd.random() < (0.3 + 0.2 * g)]
    pairs += [(9, 1, lt, rt) for lt in range(12) for rt in range(10)]  # one block of equal rows
    df = spark.createDataFrame(pairs, "g bigint, o int, l bigint, r bigint")
    got = {(r.g, r.l, r.r) for r in MT.greedy_one_to_one(df, "g", "l", "r", [F.col("o")], walk_limit=limit).collect()}
    assert got == sequential(pairs)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_suppression_agrees_with_sequential_rule(spark, limit):
    rnd = random.Random(7)
    edges = [(g, a, b) for g in range(3) for a in range(15) for b in range(a + 1, 15) if rnd.random() < 0.2]
    want = set()
    for g in range(3):
        kept = []
        for n in range(15):
            if any((g, k, n) in set(edges) for k in kept):
                want.add((g, n))
            else:
                kept.append(n)
    df = spark.createDataFrame([(g, a, b, b) for g, a, b in edges], "g bigint, hi bigint, lo bigint, ord bigint")
    assert {(r.g, r.id) for r in MT.greedy_suppressed(df, "g", walk_limit=limit).collect()} == want


def random_boxes(seed, n=40):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randint(0, 600), rnd.randint(0, 400)
        out.append((i % 3, i, x, y, x + rnd.randint(5, 220), y + rnd.randint(5, 200)))
    return out


def test_overlap_pairs_complete_and_unique(spark):
    rows = random_boxes(3, 60)
    df = spark.createDataFrame(rows, "scan_id bigint, pos bigint, x1 int, y1 int, x2 int, y2 int")
    got = [(r.a_pos, r.b_pos) for r in MT.overlap_pairs(df, df, "scan_id", 64).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])}
    assert len(got) == len(set(got)) and set(got) == want


def test_photo_merge_matches_sequential_rule(spark):
    rows = [(s, p, x1, y1, x2, y2, (p * 37 % 11) / 11, "k%d" % (p % 2), 1 + p % 2) for s, p, x1, y1, x2, y2 in random_boxes(11, 60)]
    df = spark.createDataFrame(rows, "scan_id bigint, pos bigint, x1 int, y1 int, x2 int, y2 int, confidence double, key string, photo int")

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        if w <= 0 or h <= 0:
            return 0
        return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)

    want = set()
    for scan in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == scan), key=lambda r: (r[8], r[1])):
            for i, k in enumerate(kept):
                if k[7] == r[7] and iou(r, k) >= 0.3:
                    if r[6] > k[6]:
                        kept[i] = r
                    break
            else:
                kept.append(r)
        want |= {(k[0], k[1]) for k in kept}
    assert {(r.scan_id, r.pos) for r in B.merge_photos(df, iou=0.3).collect()} == want


def test_merged_columns_cover_their_boxes(spark):
    rows = [(1, 0, 10, 10, 60, 100), (1, 1, 12, 12, 58, 40), (1, 2, 200, 10, 260, 100), (1, 3, 10, 300, 60, 390)]
    df = spark.createDataFrame(rows, "scan_id bigint, pos bigint, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r.x1, r.y1, r.x2, r.y2) for r in B.merge_columns(df).collect())
    assert got == [(10, 10, 60, 100), (10, 300, 60, 390), (200, 10, 260, 100)]


def test_components(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(0, 5), (5, 7), (7, 3), (8, 9)], "a bigint, b bigint")
    got = {r.id: r.component for r in MT.connected_components(nodes, edges).collect()}
    assert got[3] == got[7] == got[5] == got[0] == 0 and got[9] == got[8] == 8 and got[11] == 11


def test_similar_pairs_exact(spark):
    rnd = random.Random(5)
    vecs = []
    for i in range(60):
        v = [rnd.gauss(0, 1) + (3 if i % 4 == k else 0) for k in range(4)]
        n = sum(x * x for x in v) ** 0.5
        vecs.append((i, [x / n for x in v]))
    vecs.append((60, vecs[0][1]))
    want = {(a, b) for a, va in vecs[:60] for b, vb in vecs[:60] if a < b and sum(x * y for x, y in zip(va, vb)) >= 0.9}
    df = spark.createDataFrame(vecs, "id bigint, vec array<double>")
    assert {(r.a, r.b) for r in V.similar_pairs(df, 0.9).collect()} == want


def test_top_k_blocks_agree(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.random() for _ in range(6)]) for i in range(50)]
    q = spark.createDataFrame(rows[:20], "qid bigint, vec array<double>")
    c = spark.createDataFrame(rows[20:], "sku bigint, vec array<double>")
    one = {(r.qid, r.rank): r.sku for r in V.top_k(q, c, 3).collect()}
    many = {(r.qid, r.rank): r.sku for r in V.top_k(q, c, 3, block=7).collect()}
    assert one == many and len(one) == 60
