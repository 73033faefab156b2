"""Labels of facings from their shelf row: propagation over several hops, nearest labelled neighbour, votes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.operators.vectors import dot
from shelfwright.session import cut_lineage

ROW = ["scan_id", "row_idx"]
PROPAGATE, CONSENSUS = 0.90, 0.86  # fixed values: least similarity of a propagated and of a row label
#: Vectors up to which packs are joined with them, those of a tile, and pairs that a task has at a time.
FEW_VECTORS, VECTOR_TILE, TILE_PAIRS = 10000, 16384, 1 << 19
TYPE_SHARE, COLOUR_SHARE = 0.60, 0.55  # fixed values: least share of the votes, and of the facings of a row


def open_rows(facings: DataFrame) -> DataFrame:
    """Facings of the shelf rows that have an unlabelled one; the others neither give nor take a label."""
    open_ = F.max(F.col("brand").isNull()).over(Window.partitionBy(*ROW))
    return facings.withColumn("has_open", open_).where("has_open").drop("has_open")


def similar_in_row(facings: DataFrame, vectors: DataFrame, threshold: float, few: int | None = None) -> DataFrame:
    """(scan_id, row_idx, uid, kid, score) of each unlabelled pack of a row against every pack of it; packs are distinct vectors.

    ``facings`` = (scan_id, row_idx, vid, brand; null where unlabelled), ``vectors`` = (id, vec). A pack without a vector has no pairs.
    Up to ``few`` (FEW_VECTORS) vectors are joined with the packs, which then meet by row. More of them lie in tiles, and pairs of packs
    come to the tiles of their two vectors as numbers, so that a vector is copied for each tile and not for each pack.
    """
    n, short, long_, holes = vectors.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec")), F.count_if(F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull()))).first()
    packs = facings.select(*ROW, "vid", F.col("brand").isNull().alias("open")).repartition(*ROW).distinct()
    if n > (FEW_VECTORS if few is None else few) and short == long_ and not holes:
        return _similar_by_tiles(packs, vectors, threshold, n)
    # Dealt by row before they have vectors: where Spark broadcasts these, no vector is shuffled.
    packs = packs.join(vectors.withColumnRenamed("id", "vid"), "vid")
    u = packs.where("open").select(*ROW, F.col("vid").alias("uid"), F.col("vec").alias("uv"))
    k = packs.select(*ROW, F.col("vid").alias("kid"), F.col("vec").alias("kv")).dropDuplicates([*ROW, "kid"])
    return u.join(k, ROW).withColumn("score", dot(F.col("uv"), F.col("kv"))).where(F.col("score") >= threshold).select(*ROW, "uid", "kid", "score")


def _similar_by_tiles(packs: DataFrame, vectors: DataFrame, threshold: float, n: int) -> DataFrame:
    u = packs.where("open").select(*ROW, F.col("vid").alias("uid"))
    k = packs.select(*ROW, F.col("vid").alias("kid")).dropDuplicates([*ROW, "kid"])
    pairs = cut_lineage(u.join(k, ROW))
    tiles = -(-n // VECTOR_TILE)
    slots = -(-pairs.count() // (tiles * tiles * TILE_PAIRS)) or 1  # tasks of a pair of tiles
    tile = lambda col: F.pmod(F.xxhash64(col), F.lit(tiles)).cast("int")
    p = pairs.select(tile("uid").alias("p"), tile("kid").alias("q"), F.pmod(F.xxhash64(*ROW), F.lit(slots)).cast("int").alias("slot"), *ROW, "uid", "kid")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = vectors.withColumn("tile", tile("id")).withColumn("other", every(tiles)).withColumn("slot", every(slots))
    v = own.select(F.col("tile").alias("p"), F.col("other").alias("q"), "slot", "id", "vec").unionByName(
        own.where("tile <> other").select(F.col("other").alias("p"), F.col("tile").alias("q"), "slot", "id", "vec"))

    def scored(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        if not pairs.num_rows or not vectors.num_rows:
            return pairs.slice(0, 0).select([*ROW, "uid", "kid"]).append_column("score", pa.array([], pa.float64()))
        ids = vectors.column("id").to_numpy()
        order = np.argsort(ids)
        x = vectors.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order].T.astype(np.float64)
        ids = ids[order]
        held, scores = [], []
        for a in range(0, pairs.num_rows, TILE_PAIRS // 8):
            part = pairs.slice(a, TILE_PAIRS // 8)
            one, two = part.column("uid").to_numpy(), part.column("kid").to_numpy()
            i, j = (np.minimum(np.searchsorted(ids, v), len(ids) - 1) for v in (one, two))
            total = np.zeros(len(i))
            for d in x:  # in the order of ``dot``
                total += d[i] * d[j]
            keep = (ids[i] == one) & (ids[j] == two) & (total >= threshold)
            held.append(part.select([*ROW, "uid", "kid"]).filter(pa.array(keep)))
            scores.append(total[keep])
        return pa.concat_tables(held).append_column("score", pa.array(np.concatenate(scores)))

    kind = lambda c: f"{c} {pairs.schema[c].dataType.simpleString()}"
    key = ["p", "q", "slot"]
    return p.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(scored, ", ".join(map(kind, [*ROW, "uid", "kid"])) + ", score double")


def propagate(facings: DataFrame, vectors: DataFrame, threshold: float = PROPAGATE, max_hops: int | None = None) -> DataFrame:
    """(scan_id, pos, brand, confidence, hop) of unlabelled facings that take the label of the most similar labelled pack of their row.

    Packs labelled in one hop are labelled packs of the next, until none is added or ``max_hops`` are done. Of equal similarities the
    least brand counts. Vectors are compared once; a hop joins keys only. The confidence is 0.98 of the similarity, at most 0.97.
    """
    facings = cut_lineage(open_rows(facings.select(*ROW, "pos", "vid", "brand")))  # read three times
    pairs = cut_lineage(similar_in_row(facings, vectors, threshold))
    known = facings.where("brand IS NOT NULL").select(*ROW, F.col("vid").alias("kid"), "brand").distinct()
    done, last, hop = None, known, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        free = pairs if done is None else pairs.join(done.select(*ROW, "uid"), [*ROW, "uid"], "left_anti")
        best = free.join(last, [*ROW, "kid"]).groupBy(*ROW, "uid").agg(F.min_by(F.struct("brand", "score"), F.struct(-F.col("score"), F.col("brand"))).alias("m"))
        got = cut_lineage(best.select(*ROW, "uid", "m.brand", "m.score", F.lit(hop).alias("hop")))
        done = got if done is None else cut_lineage(done.unionByName(got))
        if got.isEmpty():
            break
        last = got.select(*ROW, F.col("uid").alias("kid"), "brand")
    if done is None:
        return facings.limit(0).select("scan_id", "pos", "brand", F.lit(0.0).alias("confidence"), F.lit(0).alias("hop"))
    sure = F.bround(F.least(F.lit(0.97), F.col("score") * 0.98), 4).alias("confidence")
    return facings.where("brand IS NULL").drop("brand").join(done.withColumnRenamed("uid", "vid"), [*ROW, "vid"]).select("scan_id", "pos", "brand", sure, "hop")


def row_consensus(facings: DataFrame, vectors: DataFrame, threshold: float = CONSENSUS) -> DataFrame:
    """(scan_id, pos, brand, confidence) of unlabelled facings from the most similar labelled facing of their row.

    A facing whose own text names another brand of its row stays unlabelled. The confidence is 0.95 of the neighbour's, at most 0.92;
    of equal similarities the least brand, then its highest confidence counts.
    """
    facings = cut_lineage(open_rows(facings.select(*ROW, "pos", "vid", "brand", "confidence", "pack_text")))  # read five times
    named = facings.where("brand IS NOT NULL")
    known = named.groupBy(*ROW, F.col("vid").alias("kid"), "brand").agg(F.max("confidence").alias("sure"))
    best = (similar_in_row(facings, vectors, threshold).join(known, [*ROW, "kid"]).groupBy(*ROW, F.col("uid").alias("vid"))
            .agg(F.min_by(F.struct("brand", "sure"), F.struct(-F.col("score"), F.col("brand"), -F.col("sure"))).alias("m")).select(*ROW, "vid", "m.*"))
    words = facings.where("brand IS NULL").select("scan_id", "row_idx", "pos", F.explode(F.array_distinct(F.split(F.lower("pack_text"), r"\s+"))).alias("word"))
    brands = named.select(*ROW, F.lower("brand").alias("word")).distinct()
    said = words.join(brands, [*ROW, "word"]).select("scan_id", "pos", F.col("word").alias("said"))
    got = facings.where("brand IS NULL").select("scan_id", "row_idx", "pos", "vid").join(best, [*ROW, "vid"])
    other = said.join(got.select("scan_id", "pos", F.lower("brand").alias("own")), ["scan_id", "pos"]).where("said <> own").select("scan_id", "pos").distinct()
    return got.join(other, ["scan_id", "pos"], "left_anti").select("scan_id", "pos", "brand", F.bround(F.least(F.lit(0.92), F.col("sure") * 0.95), 4).alias("confidence"))


def _leading(votes: DataFrame, total: Column, least: float) -> DataFrame:
    agg = votes.groupBy(*ROW).agg(F.min_by(F.struct("value", "w"), F.struct(-F.col("w"), F.col("value"))).alias("m"), total.alias("t")).where("m.value IS NOT NULL")
    return agg.where(F.col("m.w") / F.col("t") >= least).select(*ROW, F.col("m.value").alias("value"), F.bround(F.col("m.w") / F.col("t"), 4).alias("share"))


def type_vote(facings: DataFrame, text_type: Column, label_type: Column, least: float = TYPE_SHARE) -> DataFrame:
    """(scan_id, row_idx, value, share): the product type with at least ``least`` of a row's votes; a type in the pack text has two votes,
    else the type of the label has one. Facings without either do not vote."""
    kind = F.coalesce(text_type, label_type)
    votes = facings.select(*ROW, kind.alias("value"), F.when(text_type.isNotNull(), 2).otherwise(1).alias("n")).where("value IS NOT NULL")
    return _leading(votes.groupBy(*ROW, "value").agg(F.sum("n").alias("w")), F.sum("w"), least)


def colour_vote(facings: DataFrame, colour: Column, least: float = COLOUR_SHARE) -> DataFrame:
    """(scan_id, row_idx, value, share): the colour that at least ``least`` of all facings of a row have; null colours count as facings only."""
    per = facings.groupBy(*ROW, colour.alias("value")).agg(F.count("*").alias("n"))
    return _leading(per.withColumn("w", F.when(F.col("value").isNull(), 0).otherwise(F.col("n"))), F.sum("n"), least)
