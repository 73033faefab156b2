"""Greedy one-to-one assignment, greedy suppression, spatial joins and components.

No group is ever collected: groups of checked size are read in order by one task that remembers only
used rows; larger ones go through rounds of aggregations and joins on (group, row) keys, which spread
one scan with very many candidates over the cluster like many small ones.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.session import cut_lineage


# Groups up to this many pairs are walked in order by one task; larger ones are resolved in rounds.
WALK_LIMIT = 200_000
# Boxes of a scan, of both sides together, up to which they are compared directly or read by one task.
SCAN_ROWS = 200


def by_scan_size(rows: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of scans of up to ``limit`` (SCAN_ROWS) rows, and those of larger ones, written; None without any."""
    big = cut_lineage(rows.groupBy("scan_id").agg(F.count("*").alias("n")).where(F.col("n") > (SCAN_ROWS if limit is None else limit)).select("scan_id"))
    if big.isEmpty():
        return rows, None
    return rows.join(big, "scan_id", "left_anti"), cut_lineage(rows.join(big, "scan_id", "left_semi"))


def whole_scans(rows: DataFrame, order: list[str], run, schema: str | T.StructType) -> DataFrame:
    """``run`` over frames of whole scans, sorted by ``order`` (scan_id first); for scans of bounded size only."""
    def job(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(pdf):
                last = pdf["scan_id"].to_numpy() == pdf["scan_id"].iloc[-1]
                rest = pdf[last]
                if not last.all():
                    yield run(pdf[~last])
        if rest is not None:
            yield run(rest)

    return rows.repartition("scan_id").sortWithinPartitions(*order).mapInPandas(job, schema)


def kept_in_scans(rows: DataFrame, order: list[str], kept) -> DataFrame:
    """The rows that ``kept``, a mask over tables of whole scans sorted by ``order`` (scan_id first), leaves; for scans of bounded size only."""
    def job(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            rest = t
            if t.num_rows:
                scan = t.column("scan_id").combine_chunks()
                last = scan.index(scan[-1]).as_py() if scan[-1].is_valid else t.num_rows  # rows without a scan come first and need no others
                rest = t.slice(last)
                if last:
                    yield from t.slice(0, last).filter(pa.array(kept(t.slice(0, last)))).to_batches()
        if rest is not None and rest.num_rows:
            yield from rest.filter(pa.array(kept(rest))).to_batches()

    return rows.repartition("scan_id").sortWithinPartitions(*order).mapInArrow(job, rows.schema)


def greedy_one_to_one(pairs: DataFrame, group: str, left: str, right: str, order: list[Column], walk_limit: int | None = None, with_order: bool = True) -> DataFrame:
    """Pairs taken in ``order`` (ascending, then left, then right), each row used at most once.

    The columns of ``order`` come back as order_0, … unless ``with_order`` is false, which saves a join. Groups of bounded size are sorted by Spark and read once, remembering only the used rows of the
    current group. Larger groups are resolved by ``_rounds``; both give the same pairs.
    """
    limit = WALK_LIMIT if walk_limit is None else walk_limit
    p = cut_lineage(pairs.select(
        F.col(group).alias("g"), F.col(left).alias("l"), F.col(right).alias("r"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o")))
    big = cut_lineage(p.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("g"))
    if big.isEmpty():
        out = _walk_pairs(p, with_order)
    else:
        out = _walk_pairs(p.join(big, "g", "left_anti"), with_order).unionByName(_rounds(cut_lineage(p.join(big, "g", "left_semi"))).select("g", "l", "r", *["o"][:with_order]))
    return out.select(F.col("g").alias(group), F.col("l").alias(left), F.col("r").alias(right),
                      *[F.col(f"o.o{i}").alias(f"order_{i}") for i in range(len(order)) if with_order])


def _walk_pairs(p: DataFrame, with_order: bool = True) -> DataFrame:
    # Only the keys cross to Python; the order columns are joined back to the taken pairs.
    keys = p.repartition("g").sortWithinPartitions("g", "o", "l", "r").select("g", "l", "r")
    names = ["g", "l", "r"]

    def run(batches):
        current, lefts, rights = None, set(), set()
        for pdf in batches:
            keep = []
            for g, lt, rt in zip(pdf["g"].tolist(), pdf["l"].tolist(), pdf["r"].tolist()):
                if g != current:
                    current, lefts, rights = g, set(), set()
                if lt in lefts or rt in rights:
                    continue
                lefts.add(lt)
                rights.add(rt)
                keep.append((g, lt, rt))
            yield pd.DataFrame(keep, columns=names).astype("int64")

    taken = keys.mapInPandas(run, "g bigint, l bigint, r bigint")
    return taken.join(p, names).select("g", "l", "r", "o") if with_order else taken


def _rounds(p: DataFrame) -> DataFrame:
    """The same pairs without any ordered walk, for groups of any size.

    A pair that is first in the order for both of its rows is what the sequential rule takes, so all
    such pairs are taken at once and the rest is repeated without the used rows. Ties between equal
    rows would resolve one pair per round; where a set of lefts and a set of rights are all tied with
    each other at their best level, the rule pairs them in row order, which one round does by rank.
    """
    done = None
    while not p.isEmpty():
        lefts = p.groupBy("g", "l").agg(F.min("o").alias("o"))
        rights = p.groupBy("g", "r").agg(F.min("o").alias("ro"))
        # Pairs at the best level of their left row, with the neighbourhood of either side.
        lev = p.join(lefts, ["g", "l", "o"]).join(rights, ["g", "r"])
        lsig = lev.groupBy("g", "l").agg(
            F.min("r").alias("r_min"), F.count("*").alias("r_n"), F.sum(F.xxhash64("r").cast("decimal(38,0)")).alias("sig"))
        rsig = p.join(rights.withColumnRenamed("ro", "o"), ["g", "r", "o"]).groupBy("g", "r").agg(
            F.min("l").alias("l_min"), F.count("*").alias("l_n"))
        mutual = lev.where(F.col("o") == F.col("ro")).join(lsig, ["g", "l"]).join(rsig, ["g", "r"])
        first = mutual.where((F.col("r") == F.col("r_min")) & (F.col("l") == F.col("l_min"))).select("g", "l", "r", "o")
        tied = mutual.where("r_n > 1 AND l_n > 1")
        blocks = tied.groupBy("g", "o", "sig", "r_n", "l_n").agg(
            F.count("*").alias("n"), F.count_distinct("l").alias("nl"), F.count_distinct("r").alias("nr")).where(
            "nl = l_n AND nr = r_n AND n = nl * nr").select("g", "o", "sig", "r_n", "l_n")
        block = ["g", "o", "sig", "r_n", "l_n"]
        whole = tied.join(blocks, block)
        ranked = whole.select("*", F.dense_rank().over(Window.partitionBy(*block).orderBy("l")).alias("li"),
                              F.dense_rank().over(Window.partitionBy(*block).orderBy("r")).alias("ri"))
        taken = cut_lineage(first.unionByName(ranked.where("li = ri").select("g", "l", "r", "o")).distinct())
        done = taken if done is None else done.unionByName(taken)
        p = cut_lineage(p.join(taken.select("g", "l"), ["g", "l"], "left_anti")
                        .join(taken.select("g", "r"), ["g", "r"], "left_anti"))
    return p.select("g", "l", "r", "o") if done is None else done


def greedy_suppressed(edges: DataFrame, group: str, walk_limit: int | None = None) -> DataFrame:
    """Rows a greedy keep-first rule drops. Returns (group, id).

    ``edges`` = (group, hi, lo, ord): ``hi`` comes before ``lo`` and ``ord`` is the place of ``lo`` in
    the order. A row is dropped when an earlier conflicting row was kept.
    """
    limit = WALK_LIMIT if walk_limit is None else walk_limit
    e = cut_lineage(edges.select(F.col(group).alias("g"), "hi", "lo", "ord"))
    big = cut_lineage(e.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("g"))
    if big.isEmpty():
        out = _walk_edges(e)
    else:
        out = _walk_edges(e.join(big, "g", "left_anti")).unionByName(_suppress_rounds(cut_lineage(e.join(big, "g", "left_semi"))))
    return out.select(F.col("g").alias(group), "id")


def _walk_edges(e: DataFrame) -> DataFrame:
    keys = e.repartition("g").sortWithinPartitions("g", "ord", "lo").select("g", "hi", "lo")

    def run(batches):
        current, dropped = None, set()
        for pdf in batches:
            out = []
            for g, hi, lo in zip(pdf["g"].tolist(), pdf["hi"].tolist(), pdf["lo"].tolist()):
                if g != current:
                    current, dropped = g, set()
                if hi not in dropped and lo not in dropped:
                    dropped.add(lo)
                    out.append((g, lo))
            yield pd.DataFrame(out, columns=["g", "id"]).astype("int64")

    return keys.mapInPandas(run, "g bigint, id bigint")


def _suppress_rounds(e: DataFrame) -> DataFrame:
    """The same rows in rounds: rows without an earlier conflict are kept and drop their later ones."""
    e = cut_lineage(e.select("g", "hi", "lo").distinct())
    dropped = e.select("g", F.col("lo").alias("id")).limit(0)
    while not e.isEmpty():
        tops = e.select("g", "hi").join(e.select("g", F.col("lo").alias("hi")), ["g", "hi"], "left_anti").distinct()
        gone = cut_lineage(e.join(tops, ["g", "hi"], "left_semi").select("g", F.col("lo").alias("id")).distinct())
        dropped = dropped.unionByName(gone)
        e = cut_lineage(e.join(gone.withColumnRenamed("id", "lo"), ["g", "lo"], "left_anti")
                        .join(gone.withColumnRenamed("id", "hi"), ["g", "hi"], "left_anti"))
    return dropped


def overlap_pairs(a: DataFrame, b: DataFrame, group: str, cell: int = 128, limit: int | None = None) -> DataFrame:
    """Pairs of boxes of a group that overlap, each pair once. Columns of the two sides get the prefixes ``a_`` and ``b_``.

    Boxes of a group of bounded size meet on the group, so each is shuffled once; those of larger groups meet in grid cells.
    """
    limit = SCAN_ROWS if limit is None else limit
    big = None
    if limit:
        ids = a.select(group).unionAll(b.select(group))
        big = cut_lineage(ids.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(group))
        if big.isEmpty():
            return _direct_pairs(a, b, group)
        few, (a, b) = _direct_pairs(*(side.join(big, group, "left_anti") for side in (a, b)), group), (side.join(big, group, "left_semi") for side in (a, b))
    out = _pairs_by_cell(a, b, group, cell)
    return out if big is None else few.unionByName(out)


def _direct_pairs(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    named = lambda df, prefix: df.select(group, *[F.col(c).alias(prefix + c) for c in df.columns if c != group])
    meets = (F.greatest("a_x1", "b_x1") < F.least("a_x2", "b_x2")) & (F.greatest("a_y1", "b_y1") < F.least("a_y2", "b_y2"))
    known = reduce(Column.__and__, [F.col(f"{p}{c}").isNotNull() for p in ("a_", "b_") for c in ("x1", "y1", "x2", "y2")])
    return named(a, "a_").join(named(b, "b_"), group).where(known & meets)


def _pairs_by_cell(a: DataFrame, b: DataFrame, group: str, cell: int) -> DataFrame:
    """The same for groups of any size.

    Both sides are spread over grid cells and joined on the cell; a pair is reported only in the cell
    of the upper left corner of its intersection, so no de-duplication is needed.
    """
    def spread(df: DataFrame, prefix: str) -> DataFrame:
        named = df.select(F.col(group).alias("g"), *[F.col(c).alias(prefix + c) for c in df.columns if c != group])
        lo = lambda c: F.floor(F.col(prefix + c) / cell).cast("int")
        hi = lambda c: F.greatest(F.floor((F.col(prefix + c) - 1) / cell).cast("int"), lo(c.replace("2", "1")))
        return named.withColumn("cx", F.explode(F.sequence(lo("x1"), hi("x2")))).withColumn(
            "cy", F.explode(F.sequence(lo("y1"), hi("y2"))))

    j = spread(a, "a_").join(spread(b, "b_"), ["g", "cx", "cy"])
    left, top = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    meets = (left < F.least("a_x2", "b_x2")) & (top < F.least("a_y2", "b_y2"))
    home = (F.col("cx") == F.floor(left / cell)) & (F.col("cy") == F.floor(top / cell))
    return j.where(meets & home).drop("cx", "cy").withColumnRenamed("g", group)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest reachable id; ``edges`` = (a, b), undirected.

    Every round halves path lengths by linking each node to the label of its label.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    e = cut_lineage(both)
    lab = cut_lineage(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")))
    while True:
        near = e.join(lab.select(F.col("id").alias("b"), F.col("c").alias("nc")), "b").groupBy(F.col("a").alias("id")).agg(F.min("nc").alias("nc"))
        step = lab.join(near, "id").select("id", F.least("c", "nc").alias("c"))
        jump = step.join(step.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c", "left").select(
            "id", F.least("c", F.coalesce("cc", "c")).alias("c"))
        new = cut_lineage(jump)
        changed = not new.join(lab.withColumnRenamed("c", "old"), "id").where("c <> old").isEmpty()
        lab = new
        if not changed:
            break
    return nodes.select("id").join(lab, "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def ordered_walk(df: DataFrame, keys: list[str], order: list[str], start, step, schema: str) -> DataFrame:
    """Rows of each group read once in order with a small state: ``start(row)`` and ``step(state, row)``.

    Spark partitions and sorts; a task holds one state at a time and never a group. ``step`` returns
    one output tuple. Callers reduce their rows to distinct values first, so groups stay short.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        current, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, start(row)
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
