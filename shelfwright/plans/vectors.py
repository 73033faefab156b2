"""Queries: nearest vectors, acceptance, label propagation, groups, catalogue upkeep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwright.operators import boxes as B
from shelfwright.operators import row_labels as RL
from shelfwright.operators import vectors as V
from shelfwright.plans.registry import query

c = F.col
DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
TOP = {
    "nn": f"""SELECT qid, sku, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS sku, {DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)""",
    "nn5": "SELECT * FROM nn WHERE rank <= 5",
}


def _emb(d):
    return d.table("embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vec"), "label")


def _top(d, k=5):
    e = _emb(d)
    return V.top_k(e.where("id % 2 = 0").select(c("id").alias("qid"), "vec"), e.where("id % 2 = 1").select(c("id").alias("sku"), "vec"), k)


@query("j22_nearest_vectors", "SELECT qid, sku, round_even(score, 4) AS score, rank FROM nn5", TOP)
def j22(d):
    return _top(d).withColumn("score", F.bround("score", 4))


@query("t5_top_32_vectors", "SELECT qid, count(*) AS n, round_even(min(score), 4) AS worst FROM nn WHERE rank <= 32 GROUP BY qid", TOP)
def t5(d):
    return _top(d, 32).groupBy("qid").agg(F.count("*").alias("n"), F.bround(F.min("score"), 4).alias("worst"))


@query("j31_vector_acceptance", """SELECT qid, sku, round_even(score, 4) AS score, CASE WHEN score < 0.6e0 THEN 'below' WHEN score - second >= 0.05e0 THEN 'accepted' ELSE 'tied' END AS decision FROM (SELECT qid, sku, score, lead(score) OVER (PARTITION BY qid ORDER BY rank) AS second, rank FROM nn5) WHERE rank = 1""", TOP)
def j31(d):
    return V.accept(_top(d), 0.6, 0.05)


PROP = {
    "medh": "SELECT scan_id, list_sort(list(y2 - y1))[CAST(floor(count(*) / 2) AS INT) + 1] AS med_h FROM fac GROUP BY scan_id",
    "rws": """SELECT *, sum(brk) OVER (PARTITION BY scan_id ORDER BY yc, pos) AS row_idx FROM (SELECT f.*, (y1 + y2) / 2.0e0 AS yc,
        CASE WHEN (y1 + y2) / 2.0e0 - lag((y1 + y2) / 2.0e0) OVER (PARTITION BY f.scan_id ORDER BY (y1 + y2) / 2.0e0, pos) > greatest(med_h * 0.42e0, 18.0e0) THEN 1 ELSE 0 END AS brk FROM fac f JOIN medh m ON f.scan_id = m.scan_id)""",
    "fv": "SELECT r.scan_id, r.pos, r.row_idx, r.brand, (r.pos % 1000000) % (SELECT count(*) FROM embeddings) AS vid FROM rws r",
}


def _rows_with_vectors(d):
    n = F.lit(d.table("embeddings").count())
    return B.shelf_rows(d.fac).select("scan_id", "pos", "row_idx", "brand", ((c("pos") % 1000000) % n).alias("vid"))


@query("j23_label_propagation", f"""SELECT scan_id, pos, arg_min(brand, struct_pack(s := -score, b := brand)) AS brand FROM (
    SELECT u.scan_id, u.pos, k.brand, {DOT} AS score FROM fv u JOIN fv k ON u.scan_id = k.scan_id AND u.row_idx = k.row_idx AND u.brand = 'Unknown' AND k.brand <> 'Unknown' JOIN embeddings a ON a.vec_id = u.vid JOIN embeddings b ON b.vec_id = k.vid) WHERE score >= 0.3e0 GROUP BY scan_id, pos""", PROP)
def j23(d):
    """Unknown facings take the label of the most similar known one of their row (single hop).

    Both sides are reduced to the distinct vectors of a row before they meet, so a long row costs no
    more than its distinct packs.
    """
    r, e = _rows_with_vectors(d), _emb(d)
    unk = r.where("brand = 'Unknown'")
    u = unk.select("scan_id", "row_idx", "vid").distinct().join(e.select(c("id").alias("vid"), c("vec").alias("uv")), "vid")
    k = r.where("brand <> 'Unknown'").select("scan_id", "row_idx", c("vid").alias("kid"), "brand").distinct().join(e.select(c("id").alias("kid"), c("vec").alias("kv")), "kid")
    best = u.join(k, ["scan_id", "row_idx"]).withColumn("score", V.dot(c("uv"), c("kv"))).where("score >= 0.3").groupBy("scan_id", "row_idx", "vid").agg(
        F.min_by("brand", F.struct(-c("score"), c("brand"))).alias("brand"))
    return unk.drop("brand").join(best, ["scan_id", "row_idx", "vid"]).select("scan_id", "pos", "brand")


HOPS = {
    **PROP,
    "pack": "SELECT DISTINCT scan_id, row_idx, vid, brand FROM fv",
    "sim": f"""/*stored*/ SELECT u.scan_id, u.row_idx, u.vid AS uid, k.vid AS kid, {DOT} AS score FROM (SELECT * FROM pack WHERE brand = 'Unknown') u JOIN (SELECT DISTINCT scan_id, row_idx, vid FROM pack) k ON u.scan_id = k.scan_id AND u.row_idx = k.row_idx
        JOIN embeddings a ON a.vec_id = u.vid JOIN embeddings b ON b.vec_id = k.vid WHERE {DOT} >= 0.3e0""",
    "hop1": "/*stored*/ SELECT s.scan_id, s.row_idx, uid, arg_min(struct_pack(b := brand, s := score), struct_pack(s := -score, b := brand)) AS m FROM sim s JOIN (SELECT * FROM pack WHERE brand <> 'Unknown') k ON s.scan_id = k.scan_id AND s.row_idx = k.row_idx AND s.kid = k.vid GROUP BY ALL",
    "hop2": """SELECT s.scan_id, s.row_idx, s.uid, arg_min(struct_pack(b := h.m.b, s := score), struct_pack(s := -score, b := h.m.b)) AS m FROM sim s JOIN hop1 h ON s.scan_id = h.scan_id AND s.row_idx = h.row_idx AND s.kid = h.uid
        WHERE NOT EXISTS (SELECT 1 FROM hop1 x WHERE x.scan_id = s.scan_id AND x.row_idx = s.row_idx AND x.uid = s.uid) GROUP BY ALL""",
    "near1": "SELECT s.scan_id, s.row_idx, uid, arg_min(struct_pack(b := brand, c := sure), struct_pack(s := -score, b := brand, c := -sure)) AS m FROM sim s JOIN (SELECT r.scan_id, r.row_idx, (r.pos % 1000000) % (SELECT count(*) FROM embeddings) AS vid, brand, max(confidence) AS sure FROM rws r WHERE brand <> 'Unknown' GROUP BY ALL) k ON s.scan_id = k.scan_id AND s.row_idx = k.row_idx AND s.kid = k.vid GROUP BY ALL",
}


def _labelled(d):
    n = F.lit(d.table("embeddings").count())
    label = F.when(c("brand") != "Unknown", c("brand"))
    # Places and texts are read of unlabelled facings only, confidences of labelled ones; what is not read is not shuffled.
    of = lambda name: F.when(label.isNull(), c(name)).alias(name)
    slim = d.fac.select("scan_id", of("pos"), "y1", "y2", label.alias("brand"), F.when(label.isNotNull(), c("confidence")).alias("confidence"), of("pack_text"), ((c("pos") % 1000000) % n).alias("vid"))
    return B.shelf_rows(slim)


@query("j23_propagated_hops", """SELECT f.scan_id, f.pos, h.m.b AS brand, round_even(least(0.97e0, h.m.s * 0.98e0), 4) AS confidence, hop FROM fv f JOIN (SELECT *, 1 AS hop FROM hop1 UNION ALL SELECT *, 2 FROM hop2) h
    ON f.scan_id = h.scan_id AND f.row_idx = h.row_idx AND f.vid = h.uid WHERE f.brand = 'Unknown'""", HOPS)
def j23_hops(d):
    return RL.propagate(_labelled(d), _emb(d).select("id", "vec"), 0.3, 2)


@query("j23_row_consensus", """SELECT f.scan_id, f.pos, n.m.b AS brand, round_even(least(0.92e0, n.m.c * 0.95e0), 4) AS confidence FROM fv f JOIN near1 n ON f.scan_id = n.scan_id AND f.row_idx = n.row_idx AND f.vid = n.uid JOIN rws r ON r.scan_id = f.scan_id AND r.pos = f.pos
    WHERE f.brand = 'Unknown' AND NOT EXISTS (SELECT 1 FROM rws k WHERE k.scan_id = f.scan_id AND k.row_idx = f.row_idx AND k.brand <> 'Unknown' AND k.brand <> n.m.b AND list_contains(string_split(lower(r.pack_text), ' '), lower(k.brand)))""", HOPS)
def j23_consensus(d):
    return RL.row_consensus(_labelled(d), _emb(d).select("id", "vec"), 0.3)


@query("g53_type_vote", """SELECT scan_id, row_idx, value, share FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, row_idx ORDER BY w DESC, value) AS rn, round_even(w / sum(w) OVER (PARTITION BY scan_id, row_idx), 4) AS share, w / sum(w) OVER (PARTITION BY scan_id, row_idx) AS exact FROM (
    SELECT scan_id, row_idx, value, sum(n) AS w FROM (SELECT scan_id, row_idx, split_part(product_name, ' ', 2) AS value, CASE WHEN contains(pack_text, product_name) THEN 2 ELSE 1 END AS n FROM rws WHERE contains(pack_text, product_name) OR brand <> 'Unknown') GROUP BY ALL)) WHERE rn = 1 AND exact >= 0.6e0""", PROP)
def g53_type(d):
    kind = F.split("product_name", " ")[1]
    return RL.type_vote(B.shelf_rows(d.fac), F.when(c("pack_text").contains(c("product_name")), kind), F.when(c("brand") != "Unknown", kind))


@query("g53_colour_vote", """SELECT scan_id, row_idx, value, round_even(w / t, 4) AS share FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, row_idx ORDER BY w DESC, value) AS rn, sum(n) OVER (PARTITION BY scan_id, row_idx) AS t FROM (
    SELECT *, CASE WHEN value IS NULL THEN 0 ELSE n END AS w FROM (SELECT scan_id, row_idx, value, count(*) AS n FROM (SELECT scan_id, row_idx, CASE WHEN x1 % 7 <> 0 THEN split_part(variant, ' ', 1) END AS value FROM rws) GROUP BY scan_id, row_idx, value))) WHERE rn = 1 AND value IS NOT NULL AND w / t >= 0.55e0""", PROP)
def g53_colour(d):
    """The first word of a variant stands for the colour of its pack; one facing in seven shows none."""
    return RL.colour_vote(B.shelf_rows(d.fac), F.when(c("x1") % 7 != 0, F.split("variant", " ")[0]))


@query("g53_row_majority", """SELECT scan_id, row_idx, type, share FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, row_idx ORDER BY w DESC, type) AS rn, round_even(w / sum(w) OVER (PARTITION BY scan_id, row_idx), 4) AS share FROM (
    SELECT scan_id, row_idx, type, sum(w) AS w FROM (SELECT scan_id, row_idx, split_part(product_name, ' ', 2) AS type, CASE WHEN contains(pack_text, product_name) THEN 2 ELSE 1 END AS w FROM rws) GROUP BY ALL)) WHERE rn = 1 AND share >= 0.55e0""", PROP)
def g53(d):
    w = F.when(c("pack_text").contains(c("product_name")), 2).otherwise(1)
    per = B.shelf_rows(d.fac).groupBy("scan_id", "row_idx", F.split("product_name", " ")[1].alias("type")).agg(F.sum(w).alias("w"))
    agg = per.groupBy("scan_id", "row_idx").agg(F.min_by(F.struct("type", "w"), F.struct(-c("w"), c("type"))).alias("m"), F.sum("w").alias("t"))
    return agg.select("scan_id", "row_idx", "m.type", F.bround(c("m.w") / c("t"), 4).alias("share")).where("share >= 0.55")


@query("g54_row_recovery", """SELECT u.scan_id, u.pos, coalesce(n.brand, CASE WHEN m.cnt >= 2 THEN m.brand END) AS brand FROM (SELECT * FROM rws WHERE brand = 'Unknown') u
    LEFT JOIN (SELECT u.scan_id, u.pos, min(k.brand) AS brand FROM rws u JOIN rws k ON u.scan_id = k.scan_id AND u.row_idx = k.row_idx AND u.brand = 'Unknown' AND k.brand <> 'Unknown' AND u.pack_text <> '' AND contains(lower(u.pack_text), split_part(k.product_name, ' ', 2)) GROUP BY u.scan_id, u.pos) n ON u.scan_id = n.scan_id AND u.pos = n.pos
    LEFT JOIN (SELECT scan_id, row_idx, arg_min(brand, struct_pack(c := -cnt, b := brand)) AS brand, max(cnt) AS cnt FROM (SELECT scan_id, row_idx, brand, count(*) AS cnt FROM rws WHERE brand <> 'Unknown' GROUP BY ALL) GROUP BY ALL) m ON u.scan_id = m.scan_id AND u.row_idx = m.row_idx""", PROP)
def g54(d):
    """Unknown facings take the brand of a row neighbour whose product type their text names, else the row's leading brand."""
    r = B.shelf_rows(d.fac)
    unk, known = r.where("brand = 'Unknown'"), r.where("brand <> 'Unknown'")
    kinds = known.groupBy("scan_id", "row_idx", F.split("product_name", " ")[1].alias("kind")).agg(F.min("brand").alias("b"))
    words = unk.where("pack_text <> ''").select("scan_id", "row_idx", "pos", F.explode(F.array_distinct(F.split(F.lower("pack_text"), r"[^a-z0-9]+"))).alias("kind"))
    named = words.join(kinds, ["scan_id", "row_idx", "kind"]).groupBy("scan_id", "pos").agg(F.min("b").alias("named"))
    lead = known.groupBy("scan_id", "row_idx", "brand").agg(F.count("*").alias("n")).groupBy("scan_id", "row_idx").agg(
        F.min_by(F.struct("brand", "n"), F.struct(-c("n"), c("brand"))).alias("m"))
    j = unk.select("scan_id", "row_idx", "pos").join(named, ["scan_id", "pos"], "left").join(lead, ["scan_id", "row_idx"], "left")
    return j.select("scan_id", "pos", F.coalesce("named", F.when(c("m.n") >= 2, c("m.brand"))).alias("brand"))


@query("j34_row_labelling", """SELECT f.scan_id, f.pos, coalesce(CASE WHEN contains(pack_text, f.brand) THEN f.brand END, m.brand) AS label FROM rws f LEFT JOIN (SELECT scan_id, row_idx, arg_min(brand, struct_pack(c := -cnt, b := brand)) AS brand FROM (SELECT scan_id, row_idx, brand, count(*) AS cnt FROM rws GROUP BY ALL) GROUP BY ALL) m
    ON f.scan_id = m.scan_id AND f.row_idx = m.row_idx""", PROP)
def j34(d):
    """Text winner of a facing, else the candidate of its row."""
    r = B.shelf_rows(d.fac)
    lead = r.groupBy("scan_id", "row_idx", "brand").agg(F.count("*").alias("n")).groupBy("scan_id", "row_idx").agg(F.min_by("brand", F.struct(-c("n"), c("brand"))).alias("row_label"))
    return r.join(lead, ["scan_id", "row_idx"], "left").select("scan_id", "pos", F.coalesce(F.when(c("pack_text").contains(c("brand")), c("brand")), "row_label").alias("label"))


CENT = """SELECT label, i, round_even(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS x FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY label, i)"""


@query("g51_centroids", CENT)
def g51(d):
    return V.centroids(_emb(d), "label").select("label", F.posexplode("vec").alias("i", "x")).withColumn("x", F.bround("x", 5))


COMP = {
    "ed": f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {DOT} >= 0.5e0",
    "reach": "/*recursive*/ SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, ed.b FROM reach JOIN ed ON reach.r = ed.a WHERE ed.b < reach.id OR true",
}


@query("g52_similar_groups", "SELECT id, min(r) AS component FROM reach GROUP BY id", COMP)
def g52(d):
    return V.groups(_emb(d), 0.5)


@query("a8_catalogue_source", "SELECT vec_id AS sku, label, 'General' AS category, 1 AS hit_count FROM embeddings WHERE embedding IS NOT NULL")
def a8(d):
    return d.table("embeddings").where("embedding IS NOT NULL").select(c("vec_id").alias("sku"), "label", F.lit("General").alias("category"), F.lit(1).alias("hit_count"))


@query("j16_donor_vectors", """SELECT p_partkey, arg_min(vec_id, struct_pack(p := CASE WHEN vec_id = p_partkey THEN 0 WHEN vec_id % 25 + 1 = CAST(substr(p_brand, 7) AS INT) THEN 1 ELSE 2 END, v := vec_id)) AS donor FROM part, embeddings GROUP BY p_partkey""")
def j16(d):
    """Donor of each row without a vector: same SKU, else same brand number, else the first vector.

    Each rule is its own equi-join on a reduced donor table; the last one is a single row.
    """
    e = d.table("embeddings").select("vec_id")
    p = d.table("part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("bn"))
    by_brand = e.groupBy((c("vec_id") % 25 + 1).cast("int").alias("bn")).agg(F.min("vec_id").alias("brand_donor"))
    first = F.lit(e.agg(F.min("vec_id")).first()[0])
    j = p.join(e.select(c("vec_id").alias("p_partkey"), c("vec_id").alias("own")), "p_partkey", "left").join(by_brand, "bn", "left")
    return j.select("p_partkey", F.coalesce("own", "brand_donor", first).alias("donor"))


@query("j17_learned_merge", """SELECT p_partkey AS sku, p_partkey AS class_id FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, (SELECT max(p_partkey) FROM part WHERE p_partkey % 3 = 0) + row_number() OVER (ORDER BY p_partkey) FROM part WHERE p_partkey % 3 <> 0""")
def j17(d):
    """Unseen learned SKUs get the next class ids.

    Ids are dense: rows are range-partitioned by SKU, counted per partition, and numbered from the
    partition's offset, so no single task sorts all of them.
    """
    p = d.table("part")
    base = p.where("p_partkey % 3 = 0").select(c("p_partkey").alias("sku"), c("p_partkey").alias("class_id"))
    new = p.where("p_partkey % 3 <> 0").select(c("p_partkey").alias("sku")).join(base.select("sku"), "sku", "left_anti")
    top = base.agg(F.max("class_id")).first()[0]
    width = 4096
    slots = new.withColumn("slot", F.floor(c("sku") / width))
    counts = slots.groupBy("slot").agg(F.count("*").alias("n"))
    offset = counts.withColumn("start", F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).select("slot", F.coalesce("start", F.lit(0)).alias("start"))
    rn = F.row_number().over(Window.partitionBy("slot").orderBy("sku"))
    return base.unionByName(slots.withColumn("rn", rn).join(offset, "slot").select("sku", (F.lit(top) + c("start") + c("rn")).alias("class_id")))


@query("j18_corrections_upsert", """SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, b.quality) AS quality, coalesce(b.toxic, n.toxic) AS toxic, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS change
    FROM (SELECT * FROM labels WHERE doc_id % 3 <> 0) b FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 - quality END AS quality, toxic FROM labels WHERE doc_id % 4 = 0) n ON b.doc_id = n.doc_id""")
def j18(d):
    lab = d.table("labels")
    b = lab.where("doc_id % 3 <> 0").select("doc_id", "quality", "toxic", F.lit(True).alias("old"))
    n = lab.where("doc_id % 4 = 0").select("doc_id", F.when(c("doc_id") % 2 == 0, 1 - c("quality")).alias("q2"), c("toxic").alias("t2"), F.lit(True).alias("new"))
    change = F.when(c("old").isNull(), "added").when(c("new").isNull(), "kept").otherwise("updated")
    return b.join(n, "doc_id", "full").select("doc_id", F.coalesce("q2", "quality").alias("quality"), F.coalesce("toxic", "t2").alias("toxic"), change.alias("change"))


@query("r19_learn_sku", """SELECT coalesce(e.sku, n.sku) AS sku, coalesce(e.label, n.label) AS label, coalesce(e.hits, 0) + coalesce(n.n, 0) AS hit_count FROM (SELECT vec_id AS sku, label, 1 AS hits FROM embeddings WHERE vec_id % 2 = 0) e
    FULL JOIN (SELECT vec_id AS sku, arg_min(label, event_id) AS label, count(*) AS n FROM events JOIN embeddings ON org = vec_id GROUP BY vec_id) n ON e.sku = n.sku""".replace("events JOIN embeddings ON org = vec_id", "events JOIN embeddings ON user_id = vec_id"))
def r19(d):
    """Known SKUs gain hits, unseen ones are inserted with their first sighting."""
    e = d.table("embeddings")
    known = e.where("vec_id % 2 = 0").select(c("vec_id").alias("sku"), "label", F.lit(1).alias("hits"))
    seen = d.table("events").select(c("user_id").alias("sku"), "event_id").groupBy("sku").agg(F.count("*").alias("n"))
    new = seen.join(e.select(c("vec_id").alias("sku"), c("label").alias("l2")), "sku")
    return known.join(new, "sku", "full").select("sku", F.coalesce("label", "l2").alias("label"), (F.coalesce("hits", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("hit_count"))


# A text's picture: every pair of neighbouring words puts one point into each row of a grid, at the columns that its digest names.
ROWS, COLUMNS = V.HASH_ROWS, V.HASH_COLUMNS + 1
WORDS = r"[^\x20\x09-\x0D]+"
HASH = {
    "pw": f"SELECT doc_id AS id, regexp_extract_all(text, '{WORDS}') AS w FROM documents",
    "pp": "SELECT id, md5(a || ' ' || b) AS h FROM (SELECT id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM pw WHERE len(w) > 1) UNION ALL SELECT id, md5(w[1] || ' ') AS h FROM pw WHERE len(w) = 1",
    "pc": f"SELECT id, k, CAST('0x' || substr(h, 2 * k + 1, 2) AS INT) % {COLUMNS} AS c FROM (SELECT id, h, unnest(range({ROWS})) AS k FROM pp)",
    "pr": "SELECT id, k, [" + ", ".join(f"count(*) FILTER (c = {i})" for i in range(COLUMNS)) + "] AS g FROM pc GROUP BY id, k",
    "ph": "SELECT id, list(v ORDER BY k) AS hash FROM (SELECT id, k, " + " + ".join(f"(g[{i + 2}] > g[{i + 1}])::INT * {1 << (COLUMNS - 2 - i)}" for i in range(COLUMNS - 1)) + " AS v FROM pr) GROUP BY id",
    "pg": "SELECT hash, min(id) AS id FROM ph GROUP BY hash",
    "pd": "SELECT a.id AS a, b.id AS b, CAST(" + " + ".join(f"bit_count(xor(a.hash[{k}], b.hash[{k}]))::INT" for k in range(1, ROWS + 1)) + " AS INT) AS dist FROM pg a JOIN pg b ON a.id < b.id",
}


def _pictures(d):
    """(id, hash) of every text with a word; a text of one word counts as a pair with nothing."""
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    pairs = F.when(F.size("w") == 1, F.array(F.md5(F.concat(c("w")[0], F.lit(" "))))).otherwise(
        F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.md5(F.concat_ws(" ", a, b))))
    digests = F.unhex(F.array_join(pairs, ""))  # 16 bytes a pair
    t = d.spread("documents").select(c("doc_id").alias("id"), words.alias("w")).where("size(w) > 0").select("id", digests.alias("points"))

    def draw(batches):
        row = np.arange(ROWS) * COLUMNS
        for batch in batches:
            grids = np.array([np.bincount((np.frombuffer(p.as_buffer(), np.uint8).reshape(-1, ROWS) % COLUMNS + row).ravel(), minlength=ROWS * COLUMNS)
                              for p in batch.column("points")], np.int64).reshape(-1, ROWS * COLUMNS)
            grid = pa.ListArray.from_arrays(np.arange(len(grids) + 1, dtype=np.int32) * (ROWS * COLUMNS), grids.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), grid], names=["id", "grid"])

    return t.mapInArrow(draw, "id long, grid array<long>").select("id", V.difference_hash(c("grid")).alias("hash"))


@query("j29_near_photos", "SELECT a, b, dist FROM pd WHERE dist <= 30", HASH)
def j29(d):
    return V.near_hashes(_pictures(d), 30)


@query("j29_less_near_photos", "SELECT a, b, dist FROM pd WHERE dist <= 47", HASH)
def j29c(d):
    return V.near_hashes(_pictures(d), 47)


@query("j29_wide_photos", "SELECT a, b, dist FROM pd WHERE dist <= 80", HASH)
def j29d(d):
    return V.near_hashes(_pictures(d), 80)


@query("j29_exact_copies", "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def j29b(d):
    """Identical content by digest: grouped, never listed as pairs."""
    return d.spread("documents").select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
