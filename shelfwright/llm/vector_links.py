"""Exact cosine links of vectors by a dual traversal of a cover tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.links import components
from shelfwright.llm.shared import let, table, written

COSINE = 0.9
#: Rows that the tree's centres are taken from, at most: those with the smallest hashes. Every row is indexed.
SAMPLE = 4096
#: Vectors of a leaf block; two blocks meet in one task.
BLOCK = 4096
SALTS = 16


def units(e: Column) -> Column:
    """The vector at length one, in double precision; null if it is null, empty, zero or has a null or non-finite component."""
    d = F.transform(e, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def scaled(top: Column) -> Column:  # no overflow; -0 becomes 0
        return F.when(top > 0, let(F.transform(d, lambda x: x / top + 0.0), unit))

    def unit(v: Column) -> Column:
        return let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: x / n))

    return F.when(e.isNotNull() & ~F.coalesce(bad, F.lit(True)), let(F.array_max(F.transform(d, lambda x: F.abs(x))), scaled))


class CoverTree:
    """Nested levels of centres: those of level k are more than 2^(1-k) apart and contain those of level k - 1; the parent of
    a centre is the nearest one of the level above."""

    def __init__(self, points: np.ndarray, most: int):
        chosen, self.sizes, self.parents = [0], [1], [np.zeros(1, int)]
        near = np.linalg.norm(points - points[0], axis=1)
        for level in range(1, 6):
            while len(chosen) < most and near.max() > 2.0 ** (1 - level):
                far = int(near.argmax())
                chosen.append(far)
                near = np.minimum(near, np.linalg.norm(points - points[far], axis=1))
            if len(chosen) > self.sizes[-1]:
                c = points[chosen]
                self.parents.append(np.argmax(c @ c[:self.sizes[-1]].T, axis=1))
                self.sizes.append(len(chosen))
        self.centres = points[chosen]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector, and its distance to its ancestor on every level (root first)."""
        node = np.argmax(x @ self.centres.T, axis=1)
        leaf, out = node, []
        for level in range(len(self.sizes) - 1, -1, -1):
            out.append(np.linalg.norm(x - self.centres[node], axis=1))
            node = self.parents[level][node] if level else node
        return leaf, np.stack(out[::-1], axis=1)

    def leaf_pairs(self, reach: np.ndarray, bound: float) -> np.ndarray:
        """Dual traversal from the root: pairs of leaves whose covering radii (``reach``: leaves x levels) leave room for a
        pair within ``bound``. A pair goes down only if its parents did."""
        path = [np.arange(self.sizes[-1])]
        for level in range(len(self.sizes) - 1, 0, -1):
            path.append(self.parents[level][path[-1]])
        path, alive = path[::-1], None
        for level, n in enumerate(self.sizes):
            radius = np.full(n, -np.inf)
            np.maximum.at(radius, path[level], reach[:, level])
            c = self.centres[:n]
            gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
            open_ = gap <= radius[:, None] + radius[None, :] + bound
            alive = open_ if alive is None else open_ & alive[np.ix_(self.parents[level], self.parents[level])]
        return np.argwhere(alive)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def block_links(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, wa: np.ndarray, wb: np.ndarray, same: bool, least: float):
    """Links between two blocks: weighed counts for both sides, and for every row the smallest id it reaches inside."""
    na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    at_a, at_b = [], []
    for s in range(0, len(a), 512):
        hit = a[s:s + 512] @ b.T >= least
        if same:
            i = np.arange(s, min(s + 512, len(a)))
            hit[i - s, i] = False
        i, j = np.nonzero(hit)
        if len(i):
            np.add.at(na, i + s, wb[j])
            np.add.at(nb, j, wa[i + s])
            at_a.append(i + s)
            at_b.append(j)
    la, lb = ra.copy(), rb.copy()
    if at_a:
        i, j = np.concatenate(at_a), np.concatenate(at_b)
        while True:
            before = la.sum(), lb.sum()
            np.minimum.at(lb, j, la[i])
            np.minimum.at(la, i, lb[j])
            if before == (la.sum(), lb.sum()):
                break
    return na, nb, la, lb


def links(nodes: DataFrame, dim: int, least: float = COSINE) -> DataFrame:
    """(node, n, low) for ``nodes`` (node, weight, unit) of one dimension: several rows per node, each with links found in one pair of
    blocks; low is the smallest node reached there. Only the tree, of at most ``SAMPLE`` centres, is on the driver."""
    spark = nodes.sparkSession
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("unit").toArrow()
    tree = CoverTree(_matrix(sample.column("unit")), max(1, min(SAMPLE, total // BLOCK)))

    def place(batches):
        for batch in batches:
            if len(batch):
                leaf, far = tree.place(_matrix(batch.column("unit")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(list(far), pa.list_(pa.float64()))], names=["node", "weight", "unit", "leaf", "far"])

    placed = written(nodes.select("node", "weight", "unit").mapInArrow(place, "node long, weight long, unit array<double>, leaf long, far array<double>"), "vector-leaves")
    depth = len(tree.sizes)
    seen = placed.groupBy("leaf").agg(F.count("*").alias("n"), *[F.max(F.col("far")[k]).alias(f"r{k}") for k in range(depth)]).toPandas()
    reach = np.full((tree.sizes[-1], depth), -np.inf)
    reach[seen["leaf"]] = seen[[f"r{k}" for k in range(depth)]].to_numpy()
    blocks = np.zeros(tree.sizes[-1], np.int64)
    blocks[seen["leaf"]] = -(-seen["n"].to_numpy() // BLOCK)
    pairs = tree.leaf_pairs(reach + 1e-9, float(np.sqrt(2 - 2 * least)) + 1e-9)
    table_ = pa.table({"leaf": pairs[:, 0], "other": pairs[:, 1], "blocks": blocks[pairs[:, 0]], "others": blocks[pairs[:, 1]]})
    meets = spark.createDataFrame(table_.to_pandas(), "leaf long, other long, blocks long, others long")
    v = placed.drop("far").join(meets, "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    v = v.withColumn("other_block", F.explode(F.expr("sequence(0L, others - 1)")))
    own, other = F.struct(F.col("leaf").alias("leaf"), F.col("block").alias("block")), F.struct(F.col("other").alias("leaf"), F.col("other_block").alias("block"))
    v = v.select(F.concat_ws(":", *[c[x].cast("string") for c in (F.least(own, other), F.greatest(own, other)) for x in ("leaf", "block")]).alias("pair"),
                 F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("side"), "node", "weight", "unit")

    def meet(t: pa.Table) -> pa.Table:
        side, node, weight, unit = t.column("side").to_numpy(), t.column("node").to_numpy(), t.column("weight").to_numpy(), _matrix(t.column("unit"))
        same = bool((side == 2).any())
        i, j = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        na, nb, la, lb = block_links(unit[i], unit[j], node[i], node[j], weight[i], weight[j], same, least)
        if same:
            return pa.table({"node": node, "n": na, "low": np.minimum(la, lb)})
        out = pa.table({"node": np.concatenate([node[i], node[j]]), "n": np.concatenate([na, nb]), "low": np.concatenate([la, lb])})
        return out.filter(pa.array(out.column("n").to_numpy() > 0))

    return v.groupBy("pair").applyInArrow(meet, "node long, n long, low long")


def groups(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding) with n_links and component_id.

    Equal unit vectors are one node with a weight, so copies are never paired. Vectors of different lengths are not linked (each length has a tree
    of its own). Rows without a usable vector link with nothing. A repeated vec_id is a row of its own; null vec_ids are allowed and not the smallest. Extra
    columns are ignored; no rows give no rows.
    """
    rows = vectors.select("vec_id", units(F.col("embedding")).alias("unit")).withColumn("rid", F.monotonically_increasing_id())
    rows = written(rows.withColumns({"dim": F.size("unit"), "k1": F.xxhash64("unit"), "k2": F.hash("unit")}), "vectors")
    full = rows.where("unit IS NOT NULL")
    nodes = written(full.groupBy("dim", "k1", "k2").agg(F.min("rid").alias("node"), F.count("*").alias("weight")), "vector-nodes")
    unit = full.select(F.col("rid").alias("node"), "unit").join(nodes, "node")
    found = None
    for dim in sorted(r.dim for r in nodes.select("dim").distinct().collect()):
        part = written(links(written(unit.where(F.col("dim") == dim), "vector-units"), dim, least), "vector-links")
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node long, n long, low long")
    roots = components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    nodes = nodes.join(counts, "node", "left").join(roots, "node", "left")
    nodes = nodes.select("k1", "k2", "dim", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.drop("unit").withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(nodes, ["k1", "k2", "dim", "salt"], "left").withColumn("root", F.coalesce("root", "rid"))
    low = rows.groupBy("root").agg(F.min("vec_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(low, ["root", "salt"]).select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id")


def op10(spark, sf_dir: str) -> DataFrame:
    """All embeddings, linked at a cosine of 0.9."""
    return groups(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
c AS (SELECT vec_id AS node, vec_id AS root FROM e UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.node),
m AS (SELECT node, min(root) AS root FROM c GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.root AS component_id, e.vec_id = m.root AS kept
FROM e JOIN m ON m.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
