"""Merkle manifest of a dataset: an append log of nodes in completion order, addressed by closed-form positions."""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm.shared import table, written

#: Children of a node, as bits; levels that one aligned builder closes, so a block has 16 ** 3 leaves; levels of the largest tree.
BITS, DEEP, LEVELS = 4, 3, 15
BLOCK = BITS * DEEP
#: Rows that are equal in everything are told apart by so many values, so that a range never holds all of them.
SALTS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every so many unsigned crc32 of a doc_id stands for a document whose text was changed after the manifest was made.
TAMPERED = 5


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as ``-`` if null, else its length in bytes, a colon and its value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def tree_key(source: Column) -> Column:
    """Non-null name of a source's tree; names sort as sources do, null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def nodes_at(level: int, n):
    """Number of nodes of a level over ``n`` leaves."""
    return -(-n >> BITS * level)


def place(level: int, j, n):
    """Position of node ``j`` of ``level`` in the log of a tree with ``n`` leaves (numbers or arrays).

    A node is written when its last leaf is. By then all nodes of its level and below that end no later are written, and those above
    that ended before its last leaf: their numbers follow from the leaf count alone.
    """
    end = np.minimum((j + 1) << BITS * level, n)
    return sum(nodes_at(m, end) for m in range(level + 1)) + sum((end - 1) >> BITS * m for m in range(level + 1, LEVELS + 1)) - 1


def sibling_places(i: int, n: int) -> list[list[int]]:
    """Positions of the siblings of leaf ``i`` in its tree's log, level by level, left to right: what a proof reads."""
    out, level = [], 0
    while (count := nodes_at(level, n)) > 1:
        first = i >> BITS << BITS
        out.append([int(place(level, j, n)) for j in range(first, min(first + (1 << BITS), count)) if j != i])
        level, i = level + 1, i >> BITS
    return out


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, …) with ``i``, a row's place among those of its tree by ``order``, and ``n``, their number.

    Rows are dealt by ranges of (tree, order) and sorted inside them; the only rows that meet are one for each range and tree. A
    tree with a third of all rows spans many ranges.
    """
    keys = ["tree", *order, "salt"]
    d = nodes.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    d = written(d.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), "merkle-order")
    by = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = d.groupBy("tree", "part").agg(F.min("line").alias("first"), F.count("*").alias("here"))
    start = start.select("tree", "part", (F.coalesce(F.sum("here").over(by), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(Window.partitionBy("tree")).alias("n"))
    return d.join(start, ["tree", "part"]).withColumn("i", F.col("line") + F.col("shift")).drop("part", "line", "shift")


LOG = "tree string, pos long, level int, j long, n long, hash string, root boolean"


def _built(nodes: DataFrame, base: int) -> DataFrame:
    """Log rows of the blocks over ``nodes`` (tree, i, n, hash), which are nodes of level ``base``; n counts leaves."""
    def job(batches):
        runs: list[list[str]] = [[] for _ in range(DEEP)]
        for batch in batches:
            made = []
            for tree, i, n, value in zip(*(batch.column(c).to_pylist() for c in ("tree", "i", "n", "hash")), strict=True):
                level, j = base, i
                if base == 0:
                    made.append((tree, level, j, n, value, n == 1))
                while level < base + DEEP and (count := nodes_at(level, n)) > 1:
                    run = runs[level - base]
                    run.append(value)
                    if (j + 1) % (1 << BITS) and j + 1 < count:
                        break
                    value = hashed("".join(run))
                    run.clear()
                    level, j = level + 1, j >> BITS
                    made.append((tree, level, j, n, value, nodes_at(level, n) == 1))
            if not made:
                continue
            trees, levels, js, ns, hashes, roots = zip(*made, strict=True)
            level, j, n = np.array(levels, np.int32), np.array(js, np.int64), np.array(ns, np.int64)
            pos = np.empty(len(made), np.int64)
            for m in range(base, base + DEEP + 1):
                pos[level == m] = place(m, j[level == m], n[level == m])
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(pos), pa.array(level), pa.array(j), pa.array(n), pa.array(hashes, pa.string()), pa.array(roots)],
                                             names=["tree", "pos", "level", "j", "n", "hash", "root"])

    d = nodes.select("tree", "i", "n", "hash", F.shiftright("i", BLOCK).alias("block"))
    return d.repartition("tree", "block").sortWithinPartitions("tree", "i").drop("block").mapInArrow(job, LOG)


def append_log(leaves: DataFrame) -> list[DataFrame]:
    """The logs of all trees over ``leaves`` (tree, i, n, hash), a part for each DEEP levels: (tree, pos, level, j, n, hash, root).

    A builder takes aligned blocks of 16 ** DEEP nodes and writes each node when its last leaf is there. The nodes that close
    blocks go on to the builders of the next levels. ``pos`` is a node's place in the whole log of its tree.
    """
    parts = [written(_built(leaves, 0), "merkle-log")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while nodes_at(DEEP * len(parts), most) > 1:
        base = DEEP * len(parts)
        closed = parts[-1].where((F.col("level") == base) & ~F.col("root")).select("tree", F.col("j").alias("i"), "n", "hash")
        parts.append(written(_built(closed, base), "merkle-log"))
    return parts


SIDES = "array<struct<left:string,right:string>>"


def _descended(members: DataFrame, log: DataFrame, above: DataFrame, base: int, finish: bool) -> DataFrame:
    """Paths of ``members`` (tree, i, n, hash), nodes of level ``base``, from those of the nodes that close their blocks.

    ``above``: (tree, block, hash, path); ``log``: the nodes of levels base to base + 2. A path lists what stands left and right of
    the node in each run up to the root. With ``finish`` the members have doc_id and altered (null: unchanged), and their rows
    have the digest of all siblings and the value folded from the altered or own leaf; else they carry ``path``.
    """
    kind = members.schema["doc_id"].dataType.simpleString() if finish else "long"
    none = {"doc_id": F.lit(None).cast(kind), "altered": F.lit(None).cast("string"), "path": F.lit(None).cast(SIDES)}
    columns = ["tree", "block", "kind", "at", "level", "n", "hash", *none]
    inside = log.where((F.col("level") >= base) & (F.col("level") < base + DEEP))
    block = F.expr(f"shiftright(j, cast({BLOCK} - {BITS} * (level - {base}) as int))")
    rows = (above.withColumns({"kind": F.lit(0), "at": F.lit(0).cast("long"), "level": F.lit(0), "n": F.lit(0).cast("long"), "doc_id": none["doc_id"], "altered": none["altered"]}).select(columns)
            .union(inside.withColumns({"block": block, "kind": F.lit(1), "at": F.col("pos"), **none}).select(columns))
            .union(members.withColumns({"block": F.shiftright("i", BLOCK), "kind": F.lit(2), "at": F.col("i"), "level": F.lit(base)} | {c: v for c, v in none.items() if c not in members.columns}).select(columns)))

    def job(batches):
        top, path, runs, spots, digests, known = None, [], {}, [], [], None
        upper, folded = "", {}

        def run(level: int, j: int, n: int) -> str:
            """The run that holds node j, read at the positions of its nodes."""
            first = j >> BITS << BITS
            if (level, first) not in runs:
                wanted = place(level, np.arange(first, min(first + (1 << BITS), nodes_at(level, n))), n)
                runs[level, first] = "".join(digests[k] for k in np.searchsorted(known, wanted))
            return runs[level, first]

        for batch in batches:
            made = []
            for what, at, n, value, doc_id, altered, sides, tree in zip(*(batch.column(c).to_pylist() for c in ("kind", "at", "n", "hash", "doc_id", "altered", "path", "tree")), strict=True):
                if what == 0:
                    top, path, runs, spots, digests, known, folded = value, [(s["left"], s["right"]) for s in sides], {}, [], [], None, {}
                    upper = "".join(a + b for a, b in path)
                elif what == 1:
                    spots.append(at)
                    digests.append(value)
                else:
                    known = np.array(spots) if known is None else known
                    own, j, level = [], at, base
                    while level < base + DEEP and nodes_at(level, n) > 1:
                        r, k = run(level, j, n), 64 * (j % (1 << BITS))
                        own.append((r[:k], r[k + 64:]))
                        level, j = level + 1, j >> BITS
                    if not finish:
                        made.append((tree, at, top, [{"left": a, "right": b} for a, b in own + path]))
                        continue
                    end = value if altered is None else altered
                    for a, b in own:
                        end = hashed(a + end + b)
                    if end not in folded:  # documents of a block share what is above it
                        last = end
                        for a, b in path:
                            last = hashed(a + last + b)
                        folded[end] = last
                    made.append((doc_id, value, top, hashed("".join(a + b for a, b in own) + upper), folded[end]))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    if finish:
        made = f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
        names, kinds = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"], [None, pa.string(), pa.string(), pa.string(), pa.string()]
        kinds[0] = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    else:
        made = f"tree string, block long, hash string, path {SIDES}"
        names, kinds = ["tree", "block", "hash", "path"], [pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))]
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "at").mapInArrow(job, made)


def _paths(leaves: DataFrame, parts: list[DataFrame], tops: DataFrame, finish: bool) -> DataFrame:
    """Proofs of all ``leaves``, block by block from the roots down; ``tops``: (tree, n, hash, path) of the roots.

    Only the blocks of one level meet the log of that level, so no node high in a tree is read once for every leaf.
    """
    start = lambda base: tops.where(  # noqa: E731  trees that end in the blocks of this level
        (F.expr(f"shiftright(n - 1, {BITS * (base + DEEP)})") == 0) & ((F.expr(f"shiftright(n - 1, {BITS * base})") > 0) | (F.lit(base) == 0))
    ).select("tree", F.lit(0).cast("long").alias("block"), "hash", "path")
    above = None
    for step in reversed(range(len(parts))):
        base = DEEP * step
        above = start(base) if above is None else above.union(start(base))
        if base:
            members = parts[step - 1].where((F.col("level") == base) & ~F.col("root")).select("tree", F.col("j").alias("i"), "n", "hash")
            log = parts[step].unionByName(parts[step - 1].where(F.col("level") == base))
            above = written(_descended(members, log, above, base, False), "merkle-paths")
        else:
            return _descended(leaves, parts[0], above, 0, finish)
    raise AssertionError("a log has at least one part")


def manifest(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame], DataFrame]:
    """(leaves, logs of the sources, logs of the tree over them, sources): what a manifest stores.

    ``leaves``: (tree, i, n, doc_id, hash, altered), ordered by doc_id in each source; ``sources``: (tree, i, n, hash): subroots in order.
    """
    col = {c: F.col(c) for c in FIELDS}
    lowered = F.translate(col["text"], string.ascii_uppercase, string.ascii_lowercase)
    changed = F.crc32(col["doc_id"].cast("string")) % TAMPERED == 0
    d = docs.select(tree_key(col["source"]).alias("tree"), "doc_id", leaf(list(col.values())).alias("hash"), F.when(changed, leaf([*list(col.values())[:-1], lowered])).alias("altered"))
    leaves = written(ordered(d, ["doc_id", "hash"]), "merkle-leaves")
    logs = append_log(leaves)
    roots = logs[0].where("root")
    for part in logs[1:]:
        roots = roots.union(part.where("root"))
    sources = written(ordered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), "hash"), ["name"]), "merkle-sources")
    return leaves, logs, append_log(sources), sources


def verify(docs: DataFrame) -> DataFrame:
    """Make the manifest of ``docs`` and check every document, some of them changed since, against it.

    Returns doc_id, leaf, subroot, root, proof_sha256 (untampered), folded_root and verified. Every source is a tree over its
    documents by doc_id (null first; equal ids by leaf, so that the order of equal rows does not matter), and the subroots,
    ordered by source, make the tree of the dataset. A proof reads siblings at closed-form positions of the logs.

    Nulls: any of the five fields may be null, and a null doc_id is never tampered with; null source is a source of its own, the
    first. Empty and very long texts are hashed whole, in the scan; texts are not shuffled. Repeated rows are leaves of their own.
    Extra columns are ignored; no rows give no rows.
    """
    leaves, logs, top_logs, sources = manifest(docs)
    ends = top_logs[0].where("root")
    for part in top_logs[1:]:
        ends = ends.union(part.where("root"))
    end = ends.select("hash").first()
    root = end[0] if end else None
    start = ends.select("tree", "n", "hash", F.lit(None).cast(SIDES).alias("path")).withColumn("path", F.expr(f"CAST(array() AS {SIDES})"))
    over = _named(_paths(sources, top_logs, start, False), sources)
    out = _paths(leaves, logs, written(over, "merkle-tops"), True)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"))


def _named(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """(tree, n, hash, path) of every source from the paths of the upper tree's leaves."""
    p = paths.select(F.col("block").alias("i"), "path")
    return sources.select("i", F.col("name").alias("tree"), F.col("leaves").alias("n"), "hash").join(p, "i").drop("i")


def op11(spark, sf_dir: str) -> DataFrame:
    """Manifest and proofs of all documents."""
    return verify(table(spark, sf_dir, "documents"))


def _sql(levels: int = 6) -> str:
    """Level by level for trees of up to 16 ** ``levels`` leaves; a level of one node is carried on as it is."""
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def tree(name: str, leaves: str) -> list[str]:
        parts = [f"{name}0 AS ({leaves})"]
        for m in range(levels):
            parts.append(f"{name}r{m} AS (SELECT t, i // 16 AS i, list(h ORDER BY i) AS a, max(c) AS c FROM {name}{m} GROUP BY t, i // 16)")
            parts.append(f"{name}{m + 1} AS (SELECT t, i, CASE WHEN c = 1 THEN a[1] ELSE sha256(array_to_string(a, '')) END AS h, (c + 15) // 16 AS c FROM {name}r{m})")
        return parts

    def climb(name: str, start: str, index: str, keep: str) -> list[str]:
        """Siblings and folded value, from the leaves of a tree to its root."""
        parts = [f"{name}c0 AS ({start})"]
        for m in range(levels):
            k = f"(({index} // {16 ** m}) % 16)::INT"
            left, right = f"array_to_string(r.a[1:{k}], '')", f"array_to_string(r.a[{k} + 2:], '')"
            parts.append(f"{name}c{m + 1} AS (SELECT {keep}, CASE WHEN r.c = 1 THEN d.proof ELSE d.proof || {left} || {right} END AS proof, "
                         f"CASE WHEN r.c = 1 THEN d.fold ELSE sha256({left} || d.fold || {right}) END AS fold "
                         f"FROM {name}c{m} d JOIN {name}r{m} r ON d.t = r.t AND r.i = {index} // {16 ** (m + 1)})")
        return parts

    plain = " || ".join(map(field, FIELDS))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    altered = " || ".join(map(field, (*FIELDS[:-1], lower)))
    steps = [
        "bits AS (SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS k FROM range(256) x(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8)",
        "tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8)",
        "x AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS tr, " + f"sha256({plain}) AS leaf, sha256({altered}) AS other, "
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda s, y: xor(t[(xor(s, y) & 255) + 1], s >> 8)), 4294967295) % 5 = 0 AS hit FROM documents, tab)",
        "y AS (SELECT *, row_number() OVER (PARTITION BY tr ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tr) AS c FROM x)",
        *tree("l", "SELECT tr AS t, i, leaf AS h, c FROM y"),
        f"s AS (SELECT t AS tr, h AS subroot, row_number() OVER (ORDER BY encode(t)) - 1 AS si, count(*) OVER () AS c FROM l{levels})",
        *tree("u", "SELECT 0 AS t, si AS i, subroot AS h, c FROM s"),
        *climb("l", "SELECT doc_id, leaf, tr AS t, i, '' AS proof, CASE WHEN hit THEN other ELSE leaf END AS fold FROM y", "d.i", "d.doc_id, d.leaf, d.t, d.i"),
        *climb("u", f"SELECT doc_id, leaf, subroot, si, 0 AS t, proof, fold FROM lc{levels} JOIN s ON t = tr", "d.si", "d.doc_id, d.leaf, d.subroot, d.si, d.t"),
    ]
    return ("WITH RECURSIVE " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM uc{levels}, u{levels}")


OP11_SQL = _sql()
