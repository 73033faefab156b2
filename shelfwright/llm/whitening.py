"""Whitening of embeddings: float32 eigenvectors of a distributed covariance, refined by matrix products in higher precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.llm.shared import table, written

#: Entries become integers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components of the result; entries beyond LARGEST in magnitude are treated like non-finite ones.
COMPONENTS, LARGEST = 16, 2.0 ** 40
#: Longest vector: the driver holds one covariance matrix of a length at a time (134 MB at this bound).
MAX_LENGTH = 4096


def quantised(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(row, x): valid rows with their integers. Null vectors and those with a null, non-finite or too large entry are dropped."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST)
    good = F.col("embedding").isNotNull() & F.forall("embedding", entry) & F.size("embedding").between(1, MAX_LENGTH)
    return rows.where(good).select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The lists of one batch, all of one length, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, S) of vectors of one length: exact integers. A task sends one row a dimension."""
    def job(batches):
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column("x"))
            n += len(x)
            part = [int(v) for v in (x - SHIFT).astype(object).sum(0)] if len(x) and np.abs(x - SHIFT).max() * len(x) > 2 ** 62 else (x - SHIFT).sum(0).tolist()
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(list(map(str, total)))], names=["i", "n", "part"])

    got = fit.select("x").mapInArrow(job, "i int, n long, part string").groupBy("i").agg(F.sum("n"), F.sum(F.col("part").cast("decimal(38,0)"))).orderBy("i").collect()
    return (got[0][1], [int(r[2]) + SHIFT * r[1] for r in got]) if got else (0, [])


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n in double precision, from exact integers where they fit a long."""
    off = np.array([s - n * SHIFT for s in total], dtype=object)
    y = x - SHIFT
    if len(y) and n * int(np.abs(y).max()) + int(np.abs(off).max()) < 2 ** 62:
        return (n * y - off.astype(np.int64)) / n
    return y - np.array([float(o) / n for o in off])


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - S) ** 2."""
    off = np.array([s - n * SHIFT for s in total], dtype=object)
    y = x - SHIFT
    most = n * int(np.abs(y).max()) + int(np.abs(off).max()) if len(y) else 0
    if most * most * x.shape[1] < 2 ** 63:
        return ((n * y - off.astype(np.int64)) ** 2).sum(1).tolist()
    return [int(v) if v < 2 ** 63 else None for v in ((n * y.astype(object) - off) ** 2).sum(1)]


def moments(fit: DataFrame, n: int, total: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the centred vectors, or of their projections; divisor n. Each task sums its own products."""
    def job(batches):
        part = None
        for batch in batches:
            y = centred(_matrix(batch.column("x")), n, total)
            y = y if project is None else y @ project
            part = y.T @ y if part is None else part + y.T @ y
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], names=["i", "row"])

    d = len(total) if project is None else project.shape[1]
    got = fit.select("x").mapInArrow(job, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in got.toLocalIterator():
        out[r.i, r.j] = r.v
    return (out + out.T) / (2 * n)


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of neighbouring eigenvalues closer than ``gap``, in groups of two and more."""
    order = np.argsort(-values)
    cut = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined(a: np.ndarray, most_rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix, to double precision.

    Start: eigenvectors of the matrix in float32. A round is four matrix products (Ogita and Aishima): with R = I - X'X and
    S = X'AX, the correction X + XE has E_ij = (S_ij + l_j R_ij) / (l_j - l_i) for eigenvalues that are told apart, and
    R_ij / 2 for those closer than the error of the round. Such a cluster is turned by the eigenvectors of its own
    small matrix X_k' (A - m I) X_k, shifted by the mean m so that small differences keep their digits. Rounds end when
    a correction is at the level of rounding. Errors fall quadratically: three rounds from float32, more behind a sub-solve.
    """
    d, scale = len(a), float(np.abs(a).max()) if a.size else 0.0
    if scale == 0.0:
        return np.zeros(d), np.eye(d)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    norm, one, before = np.linalg.norm(a, 2), np.eye(d), np.inf
    for _ in range(most_rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        error = 2 * (np.linalg.norm(s - np.diag(value), 2) + norm * np.linalg.norm(r, 2)) + 4 * d * np.finfo(float).eps * norm
        apart = value[None, :] - value[:, None]
        near = np.abs(apart) <= error
        e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1.0, apart))
        x = x + x @ e
        turned = 0.0
        for c in clusters(value, error):
            mean = value[c].mean()
            part = x[:, c].T @ (a @ x[:, c] - mean * x[:, c])
            turn = np.linalg.eigh((part + part.T) / 2)[1][:, ::-1]
            turned = max(turned, float(np.abs(part - np.diag(np.diag(part))).max()) / norm)
            x[:, c] = x[:, c] @ turn
        size = max(float(np.abs(e).max()), turned)
        if size < 4 * d * np.finfo(float).eps or (size < 1e-12 and size >= before):
            break
        before = size
    for _ in range(2):  # close eigenvalues turn within rounding in each round; what that costs in orthogonality is taken back
        x = x + x @ ((one - x.T @ x) / 2)
    value = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    return value[order] * scale, x


def _model(fit: DataFrame, components: int) -> dict:
    """What whitening of one length needs: bounded by its square."""
    n, total = sums(fit)
    v = moments(fit, n, total)
    value, vectors = refined(v)
    trace = float(np.trace(v))
    k = min(components, len(value))
    live = value[:k] > len(value) * np.finfo(float).eps * max(value[0], 0.0)
    turn = vectors[:, :k] / np.sqrt(np.where(live, value[:k], 1.0))
    worst = None
    if live.any():
        seen = moments(fit, n, total, turn[:, live])
        worst = float(np.abs(seen - np.eye(int(live.sum()))).max())
    return {"n": n, "total": total, "turn": turn, "live": live, "explained": [float(x) / trace if trace > 0 else None for x in value[:k]], "error": worst}


VALUES = T.StructType([T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                       T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])


def whitened(rows: DataFrame, components: int = COMPONENTS, keep: list[str] | None = None) -> DataFrame:
    """Per row and component: component, n, deviation, whitened, explained, identity_error, beside the columns ``keep`` (all) of ``rows``.

    The fit list is each different integer vector once: copies are merged inside tasks before a shuffle, so a vector that a
    third of all rows share is no hot key. Sums and products leave a task as one small matrix. Only matrices of
    length x length reach the driver; rows are whitened where they are, by matrix products.

    Null, null-holding, non-finite and empty vectors, and those with entries beyond 2 ** 40 or more than 4,096 of them, are dropped. Vectors of
    different lengths are whitened apart, each length by its own list, one after the other. Repeated rows count once in the list and each gets its
    rows; components of no variance have null ``whitened``, and no part in identity_error. A deviation beyond a long is null.
    Columns named like an added one are replaced; no rows give no rows.
    """
    made = VALUES.fieldNames()
    keep = [c for c in keep or rows.columns if c.lower() not in made]
    base = quantised(rows, keep)
    fit = written(base.select("x").distinct().withColumn("length", F.size("x")), "whitening-fit")
    lengths = sorted(r[0] for r in fit.select("length").distinct().collect())  # at most MAX_LENGTH
    models = {d: _model(fit.where(F.col("length") == d), components) for d in lengths}

    def job(batches):
        for batch in batches:
            x = batch.column("x")
            size = np.diff(np.asarray(x.offsets))
            for d in np.unique(size).tolist():
                m, which = models[d], pa.array(np.flatnonzero(size == d))
                values = _matrix(x.take(which))
                w = centred(values, m["n"], m["total"]) @ m["turn"]
                count, k = w.shape
                every = lambda v, t: pa.array(list(v) * count, t)
                dead = np.tile(~m["live"], count)
                parts = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), every([m["n"]] * k, pa.int64()), pa.array([v for v in deviations(values, m["n"], m["total"]) for _ in range(k)], pa.int64()),
                         pa.array(w.ravel(), mask=dead), every(m["explained"], pa.float64()), every([m["error"]] * k, pa.float64())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * k), pa.StructArray.from_arrays(parts, names=made))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(which), lists], names=["row", "values"])

    out = base.mapInArrow(job, T.StructType([base.schema["row"], T.StructField("values", T.ArrayType(VALUES))]))
    out = out.select("row", F.explode("values").alias("made"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *[F.col("made")[c].alias(c) for c in made])


def op12(spark, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    return whitened(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
