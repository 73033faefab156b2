"""Near-duplicates of word shingles by b-bit MinHash; links are confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm.links import components
from shelfwright.llm.shared import free_name, table, written
from shelfwright.llm.textarrays import is_space, lower, mix, prefix_hash, range_hash, row_of, runs, slices, windows

WORDS = 5
SIMILARITY = 75  # percent
#: A pair of similarity 0.75 shares none of the bands once in a million times; bands only find candidates.
BANDS, ROWS = 36, 4
MINIMA = BANDS * ROWS
#: Low bits of each minimum that are kept; 16 minima fill a long.
BITS = 4
LONGS = MINIMA * BITS // 64
#: Least estimate of a candidate that is confirmed: five standard deviations below the threshold.
LEAST_ESTIMATE = 0.75 - 5 * (0.75 * 0.25 / MINIMA) ** 0.5
#: Shingles of a part of documents that one task compares with those of another part.
PART_SHINGLES = 1 << 20


def shingle_sets(flat: np.ndarray, off: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row: (row, hash), sorted by both."""
    flat = lower(flat)
    start, stop = runs(~is_space(flat), off)
    row = row_of(off, start)
    word = range_hash(prefix_hash(flat), start, stop)
    rows, hashes = [], []
    if len(word) >= n:
        ok = row[n - 1:] == row[:len(row) - n + 1]
        rows.append(row[:len(row) - n + 1][ok])
        hashes.append(windows(word, n)[ok])
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            rows.append(short)
            hashes.append(windows(word, m)[first[short]] + np.uint64(m))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(75)
    return r.integers(0, 2 ** 32, MINIMA, dtype=np.uint32), r.integers(0, 2 ** 32, MINIMA, dtype=np.uint32) | np.uint32(1)


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sets that start at ``first``: band keys (sets x BANDS) and packed low bits of the minima (sets x LONGS)."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((len(first), MINIMA), np.uint32)
    for k, (s, a) in enumerate(zip(*_seeds(), strict=True)):
        minima[:, k] = np.minimum.reduceat((x ^ s) * a, first)
    keys = np.zeros((len(first), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, k::ROWS])
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(first), LONGS, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def rows_of(docs: DataFrame) -> DataFrame:
    """A row per document: rid (unique), doc_id, text_key, n_shingles, key of its set (k1, k2), bands and packed bits."""
    def job(batches):
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows, flat, off in slices(batch, "text"):
                row, h = shingle_sets(flat, off)
                n = np.bincount(row, minlength=len(off) - 1)
                full = n > 0
                first = (np.cumsum(n) - n)[full]
                k1, k2 = np.zeros((2, len(n)), np.uint64)
                bands, packed = np.zeros((0, BANDS), np.int64), np.zeros((0, LONGS), np.int64)
                if len(first):
                    k1[full], k2[full] = np.add.reduceat(mix(h), first), np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
                    bands, packed = signatures(h, first)
                at = np.concatenate([[0], np.cumsum(full)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + len(n))), rows.column(0), rows.column(1), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                     _lists(bands.ravel(), at * BANDS), _lists(packed.ravel(), at * LONGS)],
                    names=["rid", "doc_id", "text_key", "n_shingles", "k1", "k2", "bands", "bits"])
                rid += len(n)

    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(job, f"rid long, doc_id {kind}, text_key long, n_shingles long, k1 long, k2 long, bands array<long>, bits array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for ``wanted`` (node, doc_id, text_key)."""
    def job(batches):
        for batch in batches:
            for rows, flat, off in slices(batch, "text"):
                row, h = shingle_sets(flat, off)
                at = np.searchsorted(row, np.arange(len(off)))
                yield pa.RecordBatch.from_arrays([rows.column(0), _lists(h.view(np.int64), at)], names=["node", "shingles"])

    w = wanted.select("node", F.col("doc_id").alias("want_id"), F.col("text_key").alias("want_key"))
    d = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    found = d.join(w, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_key") == F.col("want_key")))
    return found.select("node", "text").mapInArrow(job, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets have the similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    p = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return p.where(100 * F.col("both") >= SIMILARITY * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b").distinct()


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of each row of ``x`` with each of ``y`` from packed low bits: equal ones less those that agree by chance."""
    differ = np.zeros((len(x), len(y)), np.uint16)
    for k in range(LONGS):
        v = x[:, k, None] ^ y[None, :, k]
        v |= v >> np.uint64(1)
        v |= v >> np.uint64(2)
        differ += np.bitwise_count(v & np.uint64(0x1111111111111111))
    chance = 1 / 2 ** BITS
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def joining_links(node: np.ndarray, root: np.ndarray, side: np.ndarray, bits: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Confirmed links between rows of different groups, as many as it takes to join those groups that links join. Rows of side 0 and 1
    are compared with each other, those of side 2 among themselves. Pairs inside a group are passed over."""
    size = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    group = np.unique(root, return_inverse=True)[1]
    flag, out = np.zeros(len(ids) + 1, np.int64), []
    others = np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1):
        b = others[(others > i) | (side[others] != 2)]
        b = b[group[b] != group[i]]
        b = b[estimate(bits[i:i + 1], bits[b])[0] >= LEAST_ESTIMATE]
        if not len(b):
            continue
        own = ids[first[i]:first[i] + size[i]]
        flag[own] = 1
        at = np.repeat(first[b] - (np.cumsum(size[b]) - size[b]), size[b]) + np.arange(size[b].sum())
        both = np.add.reduceat(flag[ids[at]], np.cumsum(size[b]) - size[b])
        flag[own] = 0
        for j in b[100 * both >= SIMILARITY * (size[i] + size[b] - both)]:
            if group[j] != group[i]:
                out.append((int(node[i]), int(node[j])))
                group[group == group[j]] = group[i]
    return out


def _labelled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs between different components, with their components (ca < cb)."""
    r = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"c{c}"))
    p = pairs.join(r("a"), "a", "left").join(r("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return p.where("ca <> cb")


def _best(pairs: DataFrame, by: list[str], order: Column, n: int) -> DataFrame:
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order, "a", "b"))).where(F.col("place") <= n)


def groups(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text_key, n_shingles, root) for every row of ``docs``; root is null for empty texts.

    1. Rows with equal sets are one node. 2. Every node meets one representative in each of its band buckets (never all pairs); the
    representative it meets most often is confirmed on full sets, then one pair for each two groups that still meet. 3. Nodes
    that buckets connect across groups are dealt out in parts; a task compares two parts by packed bits, confirms what promises the
    similarity on full sets and gives only the links that join groups. No bucket is capped, and no table of pairs is made.

    Null texts are empty; texts of white space too. Null and repeated doc_ids are allowed, ties go to the smallest. Extra
    columns are ignored. No rows give no rows.
    """
    rows = written(rows_of(docs), "near-rows")
    full = rows.where("n_shingles > 0")
    nodes = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "rid")).alias("rep")).select("k1", "k2", F.col("rep.rid").alias("node"))
    nodes = written(nodes, "near-nodes")
    sigs = written(full.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), "doc_id", "text_key", "bands", "bits"), "near-bits")
    bucket = sigs.select("node", F.explode("bands").alias("key"))
    heads = bucket.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node"))["node"].alias("head")).where("n > 1")
    shared = written(bucket.join(heads, "key"), "near-buckets")
    star = written(shared.where("node <> head").groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("met")), "near-star")
    wanted = sigs.join(shared.select("node").distinct(), "node", "left_semi")
    sets = written(full_sets(docs, wanted).dropDuplicates(["node"]), "near-sets")

    links = written(confirmed(_best(star, ["a"], F.col("met").desc(), 1).select("a", "b"), sets), "near-links")
    roots = components(links)
    again = _best(_labelled(star, roots).withColumns({"x": F.least("ca", "cb"), "y": F.greatest("ca", "cb")}), ["x", "y"], F.col("met").desc(), 1)
    links = written(links.union(confirmed(again.select("a", "b"), sets)), "near-links")
    roots = components(links)

    member = shared.select("key", "node", "head").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    member = written(member.join(mixed, "key", "left_semi").select("node", "head", "root"), "near-mixed")
    meeting = components(member.select(F.col("node").alias("a"), F.col("head").alias("b"))).select("node", F.col("root").alias("meeting"))
    rest = member.select("node", "root").distinct().join(meeting, "node").join(sigs.select("node", "bits"), "node").join(sets, "node")
    rest = written(rest, "near-meeting")
    parts = rest.groupBy("meeting").agg(F.ceil(F.sum(F.size("shingles")) / PART_SHINGLES).cast("int").alias("parts"))
    rest = rest.join(parts, "meeting").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rest = rest.select("meeting", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "root",
                       F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"), "bits", "shingles")

    def meet(t: pa.Table) -> pa.Table:
        column = lambda c: t.column(c).combine_chunks()
        bits, sh = column("bits"), column("shingles")
        off, values = np.asarray(sh.offsets), np.asarray(sh.values)
        sets_ = [values[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]
        found = joining_links(column("node").to_numpy(), column("root").to_numpy(), column("side").to_numpy(), bits.flatten().to_numpy().reshape(-1, LONGS).view(np.uint64), sets_)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    links = links.union(rest.groupBy("meeting", "p", "q").applyInArrow(meet, "a long, b long"))
    roots = written(components(links), "near-roots")

    of_set = nodes.join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    hot = _spread(rows, of_set)
    return hot.select("rid", "doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"))


def _spread(rows: DataFrame, of_set: DataFrame, salts: int = 16) -> DataFrame:
    """Give each row the root of its set; sets that many rows share meet them in ``salts`` parts."""
    r = rows.select("rid", "doc_id", "text_key", "n_shingles", "k1", "k2", F.pmod("rid", F.lit(salts)).alias("salt"))
    s = of_set.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return r.join(s, ["k1", "k2", "salt"], "left")


def labelled(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text_key, n_shingles, component_id, first): ``first`` marks one row of each group, the smallest."""
    g = written(groups(docs), "near-groups")
    low = g.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))["rid"].alias("first_rid"))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    g = g.withColumn("salt", F.pmod("rid", F.lit(16)).cast("int")).join(low, ["root", "salt"], "left")
    return g.select("rid", "doc_id", "text_key", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"),
                    (F.col("root").isNull() | (F.col("rid") == F.col("first_rid"))).alias("first"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    out = labelled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest doc_id, of repeated rows one."""
    keep = labelled(docs.select("doc_id", "text")).where("first")
    ident, key = free_name(docs, "near_id"), free_name(docs, "near_key")
    none = F.lit(-2 ** 63).cast("long")
    keep = keep.select(F.coalesce("doc_id", none).alias(ident), F.col("text_key").alias(key)).distinct()
    out = docs.withColumns({ident: F.coalesce("doc_id", none), key: F.xxhash64("text")}).join(keep, [ident, key], "left_semi")
    return out.dropDuplicates([ident, key]).select(*docs.columns)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS sh FROM w),
k AS (SELECT doc_id, md5(string_agg(sh, chr(1) ORDER BY sh)) AS k, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT k, min(doc_id) AS a, any_value(n) AS n FROM k GROUP BY k),
rs AS (SELECT s.doc_id AS a, sh, r.n FROM s JOIN r ON s.doc_id = r.a),
p AS (SELECT x.a, y.a AS b FROM rs x JOIN rs y ON x.sh = y.sh AND x.a < y.a GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT a AS node, a AS root FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT w.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, w.doc_id = coalesce(m.root, w.doc_id) AS kept
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN r ON r.k = k.k LEFT JOIN m ON m.node = r.a
"""
