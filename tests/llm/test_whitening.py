"""Whitening against exact integers and dense linear algebra on the driver."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from shelfwright.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows, length):
    """{vec_id: deviations}, n, V, mean of the vectors of one length."""
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v is not None and len(v) == length and all(c is not None and math.isfinite(c) and abs(c) <= 2.0 ** 40 for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in xs}), dtype=object)
    n, total = len(fit), fit.sum(0)
    dev = [(i, int(sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True)))) for i, x in xs]
    y = np.array((n * fit - total).astype(np.longdouble) / n)
    v = (y.T @ y / n).astype(np.float64)
    return xs, dev, n, total, v


def check(got, rows, length, tolerance=1e-7):
    xs, dev, n, total, v = plain(rows, length)
    k = min(16, length)
    got = [r for r in got if r.n_dims == length]
    assert len(got) == len(xs) * k
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=repr) == sorted(set(dev), key=repr)
    assert {r.n for r in got} == {n}
    value, vec = np.linalg.eigh(v)
    value, vec = value[::-1], vec[:, ::-1]
    live = value[:k] > length * 2.3e-16 * value[0]
    for c in range(k):
        mine = [r for r in got if r.component == c + 1]
        if not np.trace(v):
            assert all(r.explained is None and r.whitened is None and r.identity_error is None for r in mine)
            continue
        assert all(r.explained == pytest.approx(value[c] / np.trace(v), rel=1e-4, abs=1e-12) for r in mine)
        if not live[c]:
            assert all(r.whitened is None for r in mine)
            continue
        assert all(r.identity_error <= 1e-4 for r in mine)
        gap = min([abs(value[c] - value[d]) for d in range(length) if d != c] or [value[0]])
        if gap > 1e-6 * value[0]:
            want = {}
            for i, x in xs:
                want.setdefault(i, []).append(float(np.array([float(n * a - s) / n for a, s in zip(x, total, strict=True)]) @ vec[:, c] / math.sqrt(value[c])))
            pairs = [(r.whitened, want[r.vec_id]) for r in mine]
            sign = 1 if sum(abs(a - b[0]) for a, b in pairs) < sum(abs(a + b[0]) for a, b in pairs) else -1
            assert all(min(abs(sign * a - x) for x in b) < tolerance * (1 + value[0] / gap) for a, b in pairs)


def collect(df, n_dims="length"):
    from pyspark.sql import functions as F
    return df.withColumn("n_dims", F.col(n_dims)).collect()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 5, -1 if v is None else len(v), "k") for i, v in rows], "vec_id long, embedding array<float>, n int, length int, row string")


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    got = whitening.op12(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    from pyspark.sql import functions as F
    check(got.withColumn("n_dims", F.lit(64)).collect(), rows, 64)


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * (j + 1) for j in range(20)]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 260)] + [(300, None), (301, [1.0] * 19 + [None]), (302, [float("nan")] * 20), (303, [float("inf")] + [0.0] * 19), (304, [])]
    rows += [(305, [1e30] * 20), (5, rows[7][1]), (400, [1.0, 2.0, 3.0]), (401, [1.0, 2.5, 3.0]), (402, [2.0, 2.0, 3.0]), (403, [7.0] * 5), (None, rows[3][1])]
    df = frame(spark, rows)
    out = whitening.whitened(df)
    assert [c for c in out.columns if c in df.columns] == ["vec_id", "embedding", "length", "row", "n"]
    got = collect(out)
    for length in (20, 3, 5):
        check(got, rows, length)
    assert {r.vec_id for r in got} == {i for i, v in rows} - {300, 301, 302, 303, 304, 305}
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(frame(spark, [(1, None)])).count() == 0


def test_large_offsets_keep_exact_sums(spark):
    r = random.Random(8)
    rows = [(i, [2.0 ** 31 + 2 ** 10 * r.randint(0, 50), -(2.0 ** 33), 1.0 * r.randint(0, 3)]) for i in range(60)]
    check(collect(whitening.whitened(frame(spark, rows))), rows, 3, 1e-5)


@pytest.mark.parametrize("spread", [0.0, 1e-14, 1e-9, 1e-6, 1e-3])
def test_refinement_of_clustered_eigenvalues(spread):
    """Groups of equal and nearly equal eigenvalues: double precision residual and orthogonality, from a float32 start."""
    rng = np.random.default_rng(5)
    d = 48
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    base = np.repeat([900.0, 40.0, 39.9, 1.0, 1e-3, 0.0], 8)
    true = base * (1 + spread * np.tile(np.arange(8), 6))
    a = (q * true) @ q.T
    a = (a + a.T) / 2
    value, x = whitening.refined(a)
    assert np.all(np.diff(value) <= 1e-12 * 900)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-13
    assert np.abs(a @ x - x * value).max() < 1e-12 * 900
    assert np.abs(value - np.sort(true)[::-1]).max() < 1e-12 * 900
    start = np.linalg.eigh((a / 900).astype(np.float32))[1].astype(np.float64)
    assert np.abs(start.T @ start - np.eye(d)).max() > 1e-9  # what float32 alone gives


def test_refinement_of_small_cases():
    assert np.allclose(whitening.refined(np.zeros((3, 3)))[0], 0)
    assert np.allclose(whitening.refined(np.array([[4.0]]))[0], [4.0])
    v, x = whitening.refined(np.eye(5) * 7)
    assert np.allclose(v, 7) and np.abs(x.T @ x - np.eye(5)).max() < 1e-14
