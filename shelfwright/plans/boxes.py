"""Queries: detection tables, spatial joins, shelf rows and columns, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwright.functions import geometry as G
from shelfwright.operators import boxes as B
from shelfwright.plans import sqlkit as S
from shelfwright.plans.registry import query

BOXES = {
    "bx": "SELECT scan_id, pos, x1, y1, x2, y2, brand, sku, category, confidence FROM fac",
    "pairs": """SELECT a.scan_id, a.pos AS ap, b.pos AS bp, a AS a, b AS b FROM bx a JOIN bx b ON a.scan_id = b.scan_id AND a.pos <> b.pos""",
}
FIRST = "(-a.confidence < -b.confidence OR (a.confidence = b.confidence AND ({aa} > {ab} OR ({aa} = {ab} AND a.pos < b.pos))))".format(aa=S.area("a"), ab=S.area("b"))
NMS = {
    **BOXES,
    "e1": f"""SELECT a.scan_id AS g, a.pos AS hi, b.pos AS lo FROM bx a JOIN bx b ON a.scan_id = b.scan_id AND a.pos <> b.pos AND {S.same_row('a', 'b')} AND {S.iou('a', 'b')} >= 0.55e0 AND {FIRST}""",
    "n1": "SELECT scan_id AS g, pos AS id, confidence, (x2 - x1) * (y2 - y1) AS ar FROM bx",
    **S.keep_walk("n1", "e1", "n.confidence DESC, n.ar DESC, n.id", "k1"),
    "bk": "SELECT b.* FROM bx b JOIN k1_kept k ON b.scan_id = k.g AND b.pos = k.id",
    "e2": f"""SELECT a.scan_id AS g, a.pos AS hi, b.pos AS lo FROM bk a JOIN bk b ON a.scan_id = b.scan_id AND a.pos <> b.pos AND {S.same_row('a', 'b')} AND {S.area('a')} > {S.area('b')}
        AND CAST({S.area('b')} AS DOUBLE) / {S.area('a')} <= 0.45e0 AND CAST({S.inter('a', 'b')} AS DOUBLE) / {S.area('b')} >= 0.72e0""",
    "n2": "SELECT scan_id AS g, pos AS id, (x2 - x1) * (y2 - y1) AS ar FROM bk",
    **S.keep_walk("n2", "e2", "n.ar DESC, n.id", "k2"),
}


@query("b1_non_max_suppression", "SELECT g AS scan_id, id AS pos FROM k2_kept", NMS)
def b1(d):
    return B.deduplicate_boxes(d.fac).select("scan_id", "pos")


TILES = {**NMS, "bx": """SELECT scan_id, pos * 2 AS pos, x1, y1, x2, y2, confidence FROM fac UNION ALL
    SELECT scan_id, pos * 2 + 1, x1 + 4, y1 + 3, x2 + 4, y2 + 3, confidence - 0.01e0 FROM fac WHERE x1 % 256 > 180"""}


@query("b6_tile_merge", "SELECT g AS scan_id, id AS pos FROM k2_kept", TILES)
def b6(d):
    """Detections of overlapping tiles: packs near a tile border are seen twice."""
    cols = ["x1", "y1", "x2", "y2"]
    full = d.fac.select("scan_id", (F.col("pos") * 2).alias("pos"), *cols, "confidence")
    tile = d.fac.where("x1 % 256 > 180").select(
        "scan_id", (F.col("pos") * 2 + 1).alias("pos"), (F.col("x1") + 4).alias("x1"), (F.col("y1") + 3).alias("y1"),
        (F.col("x2") + 4).alias("x2"), (F.col("y2") + 3).alias("y2"), (F.col("confidence") - 0.01).alias("confidence"))
    return B.deduplicate_boxes(full.unionByName(tile)).select("scan_id", "pos")


@query("j19_same_row_column", f"""SELECT a.scan_id, a.pos AS a_pos, b.pos AS b_pos, round_even({S.x_over('a', 'b')}, 4) AS x_overlap FROM bx a JOIN bx b ON a.scan_id = b.scan_id AND a.pos < b.pos
    WHERE {S.same_row('a', 'b')} AND {S.same_band('a', 'b')}""", BOXES)
def j19(d):
    return B.same_row_column(d.fac)


NEST = {
    **BOXES,
    "nested": f"""SELECT DISTINCT a.scan_id, a.pos FROM bx a JOIN bx b ON a.scan_id = b.scan_id AND a.pos <> b.pos WHERE {S.area('b')} > {S.area('a')} AND {S.same_row('a', 'b')} AND {S.inter('a', 'b')} > 0
        AND ((CAST({S.area('a')} AS DOUBLE) / {S.area('b')} <= 0.48e0 AND CAST({S.inter('a', 'b')} AS DOUBLE) / {S.area('a')} >= 0.68e0) OR {S.cap('a', 'b')})""",
    "left1": "SELECT * FROM bx b WHERE NOT EXISTS (SELECT 1 FROM nested n WHERE n.scan_id = b.scan_id AND n.pos = b.pos)",
    "medw": "SELECT scan_id, list_sort(list(x2 - x1))[CAST(floor(count(*) / 2) AS INT) + 1] AS med_w FROM left1 GROUP BY scan_id",
    "left2": "SELECT l.* FROM left1 l JOIN medw m ON l.scan_id = m.scan_id WHERE NOT (brand = 'Unknown' AND x2 - x1 < med_w * 0.42e0)",
    "left3": f"""SELECT a.scan_id, a.pos FROM left2 a WHERE NOT (a.brand = 'Unknown' AND EXISTS (SELECT 1 FROM left2 b WHERE b.scan_id = a.scan_id AND b.pos <> a.pos AND b.brand <> 'Unknown' AND b.confidence >= 0.75e0
        AND {S.inter('a', 'b')} > 0 AND {S.same_row('a', 'b')} AND {S.same_band('a', 'b')} AND ({S.cap('a', 'b')} OR {S.area('a')} < {S.area('b')} * 0.55e0)))""",
}


@query("b2_nested_facings", "SELECT scan_id, pos FROM left3", NEST)
def b2(d):
    return B.filter_nested(d.fac.select("scan_id", "pos", *B.BOX, "brand", "confidence")).select("scan_id", "pos")


@query("b5_top_partial", "SELECT scan_id, pos, exclude_from_inventory OR (y2 <= 216.0e0 AND y1 < 108.0e0) AS excluded FROM fac")
def b5(d):
    return B.top_partial(d.fac, 900).select("scan_id", "pos", "excluded")


def _merge_rounds(rounds: int = 24) -> dict[str, str]:
    """The rounds of merging, one table each; the last ones find nothing to merge."""
    xo = S.x_over("a", "b")
    narrow, gap = "least(a.x2 - a.x1, b.x2 - b.x1)", "abs((a.x1 + a.x2) / 2.0e0 - (b.x1 + b.x2) / 2.0e0)"
    up = "(a.y1 + a.y2 < b.y1 + b.y2)"
    span, between = f"(CASE WHEN {up} THEN b.y2 - a.y1 ELSE a.y2 - b.y1 END)", f"(CASE WHEN {up} THEN b.y1 - a.y2 ELSE a.y1 - b.y2 END)"
    low, high = "least(a.y2 - a.y1, b.y2 - b.y1)", "greatest(a.y2 - a.y1, b.y2 - b.y1)"
    halves = (f"({xo} >= 0.25e0 AND {gap} <= {narrow} * 0.38e0 AND {between} <= {high} * 0.4e0 AND {span} <= (CASE WHEN a.med_h > 0 THEN a.med_h ELSE {low} END) * 2.2e0 "
              f"AND (CAST({span} AS DOUBLE) / {low} BETWEEN 1.35e0 AND 2.4e0 OR (a.med_h > 0 AND {span} BETWEEN a.med_h * 0.9e0 AND a.med_h * 1.35e0)))")
    inner = S.inter("a", "b")
    body = f"({S.cap('a', 'b')} OR {S.cap('b', 'a')} OR {S.iou('a', 'b')} >= 0.12e0 OR {inner} >= 0.45e0 * {S.area('a')} AND {inner} > 0 OR {inner} >= 0.45e0 * {S.area('b')} AND {inner} > 0)"
    rule = f"{S.same_band('a', 'b')} AND ({halves} OR ({S.same_row('a', 'b')} AND {body})) AND (a.med_h <= 0 OR greatest(a.y2, b.y2) - least(a.y1, b.y1) <= a.med_h * 2.25e0)"
    out = {"mg0": "/*stored*/ SELECT f.scan_id, f.pos, x1, y1, x2, y2, coalesce(med_h, 0) AS med_h FROM fac f JOIN (SELECT scan_id, list_sort(list(y2 - y1))[CAST(floor(count(*) / 2) AS INT) + 1] AS med_h FROM fac GROUP BY scan_id) m ON f.scan_id = m.scan_id"}
    for k in range(rounds):
        out[f"mp{k}"] = f"/*stored*/ SELECT a.scan_id, a.pos AS p, b.pos AS q FROM mg{k} a JOIN mg{k} b ON a.scan_id = b.scan_id AND a.pos < b.pos AND {rule}"
        out[f"mf{k}"] = f"/*stored*/ SELECT scan_id, p, min(q) AS q FROM (SELECT * FROM mp{k} UNION ALL SELECT scan_id, q, p FROM mp{k}) GROUP BY scan_id, p"
        out[f"mg{k + 1}"] = f"""/*stored*/ SELECT g.scan_id, coalesce(m.p, g.pos) AS pos, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(med_h) AS med_h FROM mg{k} g
            LEFT JOIN (SELECT x.scan_id, x.p, x.q FROM mf{k} x JOIN mf{k} y ON x.scan_id = y.scan_id AND x.q = y.p AND y.q = x.p WHERE x.p < x.q) m ON g.scan_id = m.scan_id AND g.pos = m.q GROUP BY g.scan_id, coalesce(m.p, g.pos)"""
    return out


@query("b3_merge_split_columns", "SELECT scan_id, pos, x1, y1, x2, y2 FROM mg24", _merge_rounds())
def b3(d):
    return B.merge_columns(d.fac)


GAP = {
    **BOXES,
    "grid": """SELECT scan_id, n, n_slots, g1, (g2 - g1) / n_slots AS sw FROM (SELECT *, greatest(0.0e0, lo - med_w * 0.12e0) AS g1, least(1200.0e0, hi + med_w * 0.12e0) AS g2 FROM (
        SELECT scan_id, count(*) AS n, count(*) + 1 + scan_id % 4 AS n_slots, min(x1) AS lo, max(x2) AS hi, list_sort(list(x2 - x1))[CAST(floor(count(*) / 2) AS INT) + 1] AS med_w FROM bx GROUP BY scan_id))""",
    "cand": """SELECT b.scan_id AS g, b.pos AS l, s.slot AS r, abs((b.x1 + b.x2) / 2.0e0 - (g.g1 + (s.slot + 0.5e0) * g.sw)) AS dist, g.sw FROM bx b JOIN grid g ON b.scan_id = g.scan_id, LATERAL (SELECT unnest(range(0, g.n_slots)) AS slot) s
        WHERE abs((b.x1 + b.x2) / 2.0e0 - (g.g1 + (s.slot + 0.5e0) * g.sw)) <= g.sw * 0.62e0""",
    **S.greedy_walk("cand", "dist", "slots"),
}


@query("b4_missing_slots", """SELECT g.scan_id, s.slot, round_even(g.g1 + (s.slot + 0.5e0) * g.sw, 3) AS centre, g.n - coalesce(t.t, 0) AS leftover
    FROM grid g LEFT JOIN (SELECT g, count(*) AS t FROM slots_chosen GROUP BY g) t ON g.scan_id = t.g, LATERAL (SELECT unnest(range(0, g.n_slots)) AS slot) s
    WHERE NOT EXISTS (SELECT 1 FROM slots_chosen c WHERE c.g = g.scan_id AND c.r = s.slot)""", GAP)
def b4(d):
    expected = d.fac.groupBy("scan_id").agg((F.count("*") + 1 + F.col("scan_id") % 4).alias("n_slots"))
    return B.missing_slots(d.fac, expected, 1200)


TRUTH = {
    **BOXES,
    "truth": "SELECT scan_id, pos, x1 + CAST(pos % 23 AS INT) AS x1, y1 - CAST(pos % 9 AS INT) AS y1, x2 + CAST(pos % 31 AS INT) AS x2, y2 + CAST(pos % 7 AS INT) AS y2, category FROM fac WHERE pos % 13 <> 0",
    "p_iou": f"SELECT a.scan_id AS g, a.pos AS l, b.pos AS r, {S.iou('a', 'b')} AS iou FROM bx a JOIN truth b ON a.scan_id = b.scan_id WHERE {S.inter('a', 'b')} > 0 AND {S.iou('a', 'b')} >= 0.5e0",
    **S.greedy_walk("p_iou", "iou DESC", "mb"),
    "hits": "SELECT c.g AS scan_id, c.l AS pred_pos, c.r AS truth_pos, round_even(p.iou, 3) AS iou FROM mb_chosen c JOIN p_iou p ON c.g = p.g AND c.l = p.l AND c.r = p.r",
}


def _truth(d):
    m = lambda n: (F.col("pos") % n).cast("int")
    return d.fac.where("pos % 13 <> 0").select(
        "scan_id", "pos", (F.col("x1") + m(23)).alias("x1"), (F.col("y1") - m(9)).alias("y1"), (F.col("x2") + m(31)).alias("x2"), (F.col("y2") + m(7)).alias("y2"),
        "category", "brand", "product_name")


@query("j20_match_boxes", "SELECT * FROM hits", TRUTH)
def j20(d):
    return B.match_boxes(d.fac, _truth(d))


@query("g47_detection_metrics", """SELECT scan_id, predicted, labelled, true_positives, CASE WHEN labelled = 0 THEN CASE WHEN predicted = 0 THEN 1.0e0 ELSE 0.0e0 END ELSE round_even(true_positives / greatest(predicted, 1), 4) END AS precision,
    CASE WHEN labelled = 0 THEN 1.0e0 ELSE round_even(true_positives / greatest(labelled, 1), 4) END AS recall, predicted - labelled AS count_error
    FROM (SELECT scan_id, count(*) FILTER (k = 'p') AS predicted, count(*) FILTER (k = 't') AS labelled, count(*) FILTER (k = 'm') AS true_positives
      FROM (SELECT scan_id, 'p' AS k FROM bx UNION ALL SELECT scan_id, 't' FROM truth UNION ALL SELECT scan_id, 'm' FROM hits) GROUP BY ROLLUP (scan_id))""", TRUTH)
def g47(d):
    return B.detection_metrics(d.fac, _truth(d), B.match_boxes(d.fac, _truth(d)))


def _photos(d):
    cols = ["x1", "y1", "x2", "y2"]
    key = F.concat_ws("|", F.lower("brand"), F.lower("product_name"))
    one = d.fac.select("scan_id", "pos", *cols, "confidence", key.alias("key"), F.lit(1).alias("photo"))
    s = (F.col("pos") % 60).cast("int")
    two = d.fac.where("pos % 3 <> 0").select(
        "scan_id", (F.col("pos") + F.lit(2000000000000000000)).alias("pos"), (F.col("x1") + s).alias("x1"), "y1", (F.col("x2") + s).alias("x2"), "y2",
        (F.col("confidence") + F.lit(0.02)).alias("confidence"), key.alias("key"), F.lit(2).alias("photo"))
    return one.unionByName(two)


PHOTOS = {
    "ph1": """SELECT scan_id, pos, x1, y1, x2, y2, confidence, concat_ws('|', lower(brand), lower(product_name)) AS key, 1 AS photo FROM fac UNION ALL
        SELECT scan_id, pos + 2000000000000000000, x1 + CAST(pos % 60 AS INT), y1, x2 + CAST(pos % 60 AS INT), y2, confidence + 0.02e0, concat_ws('|', lower(brand), lower(product_name)), 2 FROM fac WHERE pos % 3 <> 0""",
    "ph2": "/*stored*/ SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY photo, pos) AS rn FROM ph1",
    "phw": f"""/*recursive*/ SELECT scan_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT, confidence DOUBLE, key VARCHAR, pos BIGINT, photo INT)[]) AS kept FROM (SELECT DISTINCT scan_id FROM ph2)
        UNION ALL SELECT scan_id, rn, CASE WHEN spot IS NULL OR spot = 0 THEN list_append(kept, b) WHEN b.confidence > kept[spot].confidence THEN list_concat(list_append(kept[1:spot - 1], b), kept[spot + 1:]) ELSE kept END
        FROM (SELECT w.scan_id, p.rn, w.kept, struct_pack(x1 := p.x1, y1 := p.y1, x2 := p.x2, y2 := p.y2, confidence := p.confidence, key := p.key, pos := p.pos, photo := p.photo) AS b,
              list_position(list_transform(w.kept, lambda a: a.key = p.key AND {S.inter('a', 'p')} > 0 AND {S.iou('a', 'p')} >= 0.45e0), true) AS spot
              FROM phw w JOIN ph2 p ON p.scan_id = w.scan_id AND p.rn = w.rn + 1)""",
    "phl": "SELECT scan_id, unnest(arg_max(kept, rn)) AS k FROM phw GROUP BY scan_id",
}


@query("j21_merge_photo_facings", "SELECT scan_id, k.pos AS pos, k.photo AS photo FROM phl", PHOTOS)
def j21(d):
    return B.merge_photos(_photos(d))


ROWS = {
    **BOXES,
    "medh": "SELECT scan_id, list_sort(list(y2 - y1))[CAST(floor(count(*) / 2) AS INT) + 1] AS med_h, list_sort(list(x2 - x1))[CAST(floor(count(*) / 2) AS INT) + 1] AS med_w FROM bx GROUP BY scan_id",
    "rows1": """SELECT *, sum(brk) OVER (PARTITION BY scan_id ORDER BY yc, pos) AS row_idx FROM (SELECT b.*, (y1 + y2) / 2.0e0 AS yc, med_w,
        CASE WHEN (y1 + y2) / 2.0e0 - lag((y1 + y2) / 2.0e0) OVER (PARTITION BY b.scan_id ORDER BY (y1 + y2) / 2.0e0, pos) > greatest(med_h * 0.42e0, 18.0e0) THEN 1 ELSE 0 END AS brk
        FROM bx b JOIN medh m ON b.scan_id = m.scan_id)""",
}


@query("w6_shelf_rows", "SELECT scan_id, pos, row_idx FROM rows1", ROWS)
def w6(d):
    return B.shelf_rows(d.fac).select("scan_id", "pos", "row_idx")


@query("w7_shelf_columns", """SELECT b.scan_id, b.pos, s.col_idx FROM bx b JOIN (SELECT *, sum(brk) OVER (PARTITION BY scan_id ORDER BY xc, x1) AS col_idx FROM (SELECT *, CASE WHEN p2 IS NULL THEN 0
      WHEN least(x2, p2) - greatest(x1, p1) <= 0 THEN CASE WHEN xc - pc <= least(x2 - x1, p2 - p1) * 0.38e0 THEN 0 ELSE 1 END
      WHEN (least(x2, p2) - greatest(x1, p1)) / CAST(least(x2 - x1, p2 - p1) AS DOUBLE) >= 0.28e0 OR xc - pc <= least(x2 - x1, p2 - p1) * 0.38e0 THEN 0 ELSE 1 END AS brk
      FROM (SELECT *, lag(x1) OVER w AS p1, lag(x2) OVER w AS p2, lag(xc) OVER w AS pc FROM (SELECT DISTINCT scan_id, x1, x2, (x1 + x2) / 2.0e0 AS xc FROM bx) WINDOW w AS (PARTITION BY scan_id ORDER BY xc, x1)))) s
    ON b.scan_id = s.scan_id AND b.x1 = s.x1 AND b.x2 = s.x2""", BOXES)
def w7(d):
    return B.shelf_columns(d.fac).select("scan_id", "pos", "col_idx")


@query("w9_gap_probes", """SELECT scan_id, row_idx, mid, centre_gap, row_number() OVER (PARTITION BY scan_id ORDER BY centre_gap DESC, row_idx, mid) AS rank FROM (
    SELECT scan_id, row_idx, (xc + nxc) / 2.0e0 AS mid, nxc - xc AS centre_gap FROM (SELECT *, lead(x1) OVER w AS nx1, lead(xc) OVER w AS nxc FROM (SELECT DISTINCT scan_id, row_idx, x1, x2, (x1 + x2) / 2.0e0 AS xc, med_w FROM rows1)
      WINDOW w AS (PARTITION BY scan_id, row_idx ORDER BY xc, x1, x2)) WHERE nx1 - x2 > med_w * 0.12e0 OR nxc - xc > med_w * 1.18e0)""", ROWS)
def w9(d):
    return B.gap_probes(B.shelf_rows(d.fac))


@query("w11_layout_class", """SELECT scan_id, n, CASE WHEN NOT one THEN 'multi_row' WHEN med_h >= 144.0e0 OR (n >= 9 AND med_w >= 72.0e0) THEN 'single_bin' ELSE 'single_row' END AS layout FROM (
    SELECT *, n < 2 OR (inside / n >= 0.70e0 AND spread <= med_h * 2.5e0) OR (n <= 18 AND spread <= greatest(315.0e0, med_h * 3.0e0) AND inside / n >= 0.65e0) AS one FROM (
    SELECT b.scan_id, count(*) AS n, any_value(med_h) AS med_h, any_value(med_w) AS med_w, any_value(spread) AS spread, count(*) FILTER (abs((y1 + y2) / 2.0e0 - mid) <= med_h * 0.65e0) AS inside
    FROM bx b JOIN medh m ON b.scan_id = m.scan_id JOIN (SELECT scan_id, (max(y1 + y2) - min(y1 + y2)) / 2.0e0 AS spread, sum(y1 + y2) / 2.0e0 / count(*) AS mid FROM bx GROUP BY scan_id) s ON b.scan_id = s.scan_id GROUP BY b.scan_id))""", ROWS)
def w11(d):
    return B.layout_class(d.fac.where("pos IS NOT NULL"), 1200, 900)


@query("f14_box_functions", f"""SELECT a.scan_id, a.pos, round_even({S.iou('a', 'b')}, 4) AS iou, round_even(CAST({S.inter('a', 'b')} AS DOUBLE) / {S.area('a')}, 4) AS inside, {S.area('a')} AS area, least(a.x1, b.x1) AS ux1, greatest(a.y2, b.y2) AS uy2,
    {S.cap('a', 'b')} AS cap FROM bx a JOIN (SELECT scan_id, pos, x1 + 20 AS x1, y1 + 10 AS y1, x2 + 45 AS x2, y2 + 90 AS y2 FROM bx) b ON a.scan_id = b.scan_id AND a.pos = b.pos""", BOXES)
def f14(d):
    f = d.fac.withColumns({"b_x1": F.col("x1") + 20, "b_y1": F.col("y1") + 10, "b_x2": F.col("x2") + 45, "b_y2": F.col("y2") + 90})
    a, b = G.box(), G.box("b_")
    u = G.union_box(a, b)
    return f.select("scan_id", "pos", F.bround(G.iou(a, b), 4).alias("iou"), F.bround(G.containment(a, b), 4).alias("inside"), G.area(a).cast("bigint").alias("area"),
                    u[0].cast("int").alias("ux1"), u[3].cast("int").alias("uy2"), G.cap_fragment(a, b).alias("cap"))


@query("f15_pixel_boxes", """SELECT scan_id, pos, CASE WHEN pos % 2 = 0 THEN CAST(floor(x1 / 1500.0e0 * 1200) AS INT) ELSE x1 END AS px1, CASE WHEN pos % 2 = 0 THEN CAST(floor(y2 / 1000.0e0 * 900) AS INT) ELSE y2 END AS py2 FROM fac""")
def f15(d):
    even = F.col("pos") % 2 == 0
    vals = F.when(even, F.array(F.col("x1") / 1500.0, F.col("y1") / 1000.0, F.col("x2") / 1500.0, F.col("y2") / 1000.0)).otherwise(
        F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]))
    px = d.fac.select("scan_id", "pos", G.to_pixels(vals, F.lit(1200), F.lit(900)).alias("b"))
    return px.select("scan_id", "pos", F.col("b")[0].alias("px1"), F.col("b")[3].alias("py2"))


@query("v28_valid_boxes", """SELECT scan_id, pos, NOT (w * h / 1080000.0e0 > 0.45e0 OR y1 < 72 OR (y1 + y2) / 2.0e0 < 90 OR (y1 < 108 AND y2 < 198) OR (w / 1200.0e0 > 0.85e0 AND y1 < 135 AND y2 < 315)
    OR (y1 < 90 AND h / 900.0e0 > 0.55e0 AND w / 1200.0e0 > 0.75e0)) AS valid FROM (SELECT scan_id, pos, y1, least(y2, 899) AS y2, greatest(least(x2, 1199) - x1, 1) AS w, greatest(least(y2, 899) - y1, 1) AS h FROM fac)""")
def v28(d):
    return B.valid_boxes(d.fac, 1200, 900).select("scan_id", "pos", "valid")


@query("v28_boxes_trusted", """SELECT *, bad = 0 AND (skus < 2 OR n >= skus) AS trusted FROM (SELECT scan_id, count(*) FILTER (x2 <= x1 OR y2 <= y1 OR y1 < 72 OR (y1 + y2) / 2.0e0 < 90) AS bad, count(*) AS n, count(DISTINCT sku) AS skus FROM fac GROUP BY scan_id)""")
def v28b(d):
    return B.boxes_trusted(d.fac, 900)


@query("t7_zip_by_order", """SELECT f.scan_id, f.pos, i.pos AS inv_pos FROM (SELECT scan_id, pos, row_number() OVER (PARTITION BY scan_id ORDER BY visible_rank NULLS FIRST, pos) AS n, count(*) OVER (PARTITION BY scan_id) AS t FROM (SELECT scan_id, pos, actual_facings AS visible_rank FROM cv)) f
    JOIN (SELECT scan_id, pos, row_number() OVER (PARTITION BY scan_id ORDER BY expected_facings, pos) AS n, count(*) OVER (PARTITION BY scan_id) AS t FROM plan) i ON f.scan_id = i.scan_id AND f.n = i.n AND f.t = i.t WHERE f.t >= 2""")
def t7(d):
    """n-th counted row with n-th planned row, only where both sides have the same length."""
    def ranked(df, col):
        w = Window.partitionBy("scan_id")
        return df.select("scan_id", "pos", F.row_number().over(w.orderBy(F.asc(col), "pos")).alias("n"), F.count("*").over(w).alias("t"))
    f = ranked(d.cv, "actual_facings").where("t >= 2")
    return f.join(ranked(d.plan, "expected_facings").withColumnRenamed("pos", "inv_pos"), ["scan_id", "n", "t"]).select("scan_id", "pos", "inv_pos")


@query("t6_visual_order", """SELECT i.scan_id, i.pos, CASE WHEN contains(p, 'top') OR contains(p, 'upper') THEN 0 WHEN contains(p, 'mid') THEN 1 WHEN contains(p, 'bottom') OR contains(p, 'floor') THEN 2 ELSE 3 END AS band, coalesce(k.ppos, 999) AS plan_pos
    FROM (SELECT *, CASE quantity % 4 WHEN 0 THEN 'upper bay' WHEN 1 THEN 'middle' WHEN 2 THEN 'floor' ELSE '' END AS p FROM inv) i
    LEFT JOIN (SELECT scan_id, brand, variant, min(pos) AS ppos FROM plan GROUP BY ALL) k ON i.scan_id = k.scan_id AND i.brand = k.brand AND i.variant = k.variant""")
def t6(d):
    q = F.col("quantity") % 4
    p = F.when(q == 0, "upper bay").when(q == 1, "middle").when(q == 2, "floor").otherwise("")
    band = F.when(p.contains("top") | p.contains("upper"), 0).when(p.contains("mid") | p.contains("center"), 1).when(
        p.contains("bottom") | p.contains("lower") | p.contains("floor"), 2).otherwise(3)
    first = d.plan.groupBy("scan_id", "brand", "variant").agg(F.min("pos").alias("ppos"))
    return d.inv.join(first, ["scan_id", "brand", "variant"], "left").select("scan_id", "pos", band.alias("band"), F.coalesce("ppos", F.lit(999)).alias("plan_pos"))


@query("u5_distinct_in_order", """SELECT scan_id // 8 AS shelf_id, brand, product_name, min(pos * 8 + scan_id % 8) AS pos FROM plan GROUP BY ALL""")
def u5(d):
    return d.plan.groupBy(F.floor(F.col("scan_id") / 8).alias("shelf_id"), "brand", "product_name").agg(F.min(F.col("pos") * 8 + F.col("scan_id") % 8).alias("pos"))


@query("w5_consecutive_runs", """SELECT scan_id, pos, brand FROM (SELECT scan_id, pos, brand, lag(brand) OVER (PARTITION BY scan_id ORDER BY row_idx, (x1 + x2), pos) AS prev FROM rows1) WHERE prev IS NULL OR prev <> brand""", ROWS)
def w5(d):
    """First row of each run of one brand along the shelf rows."""
    w = Window.partitionBy("scan_id").orderBy("row_idx", F.col("x1") + F.col("x2"), "pos")
    r = B.shelf_rows(d.fac).withColumn("prev", F.lag("brand").over(w))
    return r.where(F.col("prev").isNull() | (F.col("prev") != F.col("brand"))).select("scan_id", "pos", "brand")


J25 = {
    **ROWS,
    "nrow": "SELECT scan_id, max(row_idx) + 1 AS n FROM rows1 GROUP BY scan_id",
    "shelves": "SELECT scan_id, s, row_number() OVER (PARTITION BY scan_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS k FROM (SELECT DISTINCT scan_id // 8 AS scan_id, l_suppkey % 4 + 1 AS s FROM base)",
}


@query("j25_row_shelf_alignment", "SELECT s.scan_id, CASE WHEN n > k THEN n - k + i ELSE i END AS row_idx, s AS shelf_no FROM shelves s JOIN nrow r ON s.scan_id = r.scan_id WHERE i < n", J25)
def j25(d):
    """Photo rows to planogram shelves, aligned at the bottom when the photo shows extra rows."""
    n = B.shelf_rows(d.fac).groupBy("scan_id").agg((F.max("row_idx") + 1).alias("n"))
    text = F.concat(F.lit("Shelf "), (F.col("l_suppkey") % 4 + 1).cast("string"), F.lit(" / Position 1"))
    items = d.base.select(F.floor(F.col("scan_id") / 8).alias("scan_id"), text.alias("shelf_position"))
    num = F.regexp_extract("shelf_position", r"(?i)shelf\s*(\d+)", 1)
    shelves = items.select("scan_id", F.nullif(num, F.lit("")).try_cast("int").alias("s")).where("s IS NOT NULL").distinct()
    w = Window.partitionBy("scan_id")
    ranked = shelves.select("scan_id", "s", (F.row_number().over(w.orderBy("s")) - 1).alias("i"), F.count("*").over(w).alias("k"))
    j = ranked.join(n, "scan_id").where("i < n")
    return j.select("scan_id", F.when(F.col("n") > F.col("k"), F.col("n") - F.col("k") + F.col("i")).otherwise(F.col("i")).alias("row_idx"), F.col("s").alias("shelf_no"))


@query("j30_row_box_assignment", """SELECT scan_id, row_idx, arg_min(fpos, struct_pack(c := cls, k := k, p := fpos)) AS pos FROM (
    SELECT r.scan_id, r.row_idx, f.pos AS fpos, CASE WHEN f.y1 <= cy AND cy <= f.y2 THEN 0 WHEN ov >= 0.15e0 THEN 1 ELSE 2 END AS cls,
      CASE WHEN f.y1 <= cy AND cy <= f.y2 THEN -ov ELSE abs(cy - (f.y1 + f.y2) / 2.0e0) END AS k
    FROM (SELECT scan_id, row_idx, min(y1) AS ry1, max(y2) AS ry2, (min(y1) + max(y2)) / 2.0e0 AS cy FROM rows1 GROUP BY scan_id, row_idx) r
    JOIN (SELECT scan_id, pos, y1, y2 FROM fac WHERE ln = 2) f ON r.scan_id = f.scan_id,
    LATERAL (SELECT greatest(0, least(ry2, f.y2) - greatest(ry1, f.y1)) / CAST(greatest(1, least(ry2 - ry1, f.y2 - f.y1)) AS DOUBLE) AS ov) o) GROUP BY scan_id, row_idx""", ROWS)
def j30(d):
    """Best labelled box of each shelf row: containing, else overlapping, else nearest.

    Labelled boxes are reduced to distinct vertical spans first, so the join of a scan's few rows with
    them is bounded by pixel positions; the three classes become one aggregated minimum.
    """
    rows = B.shelf_rows(d.fac).groupBy("scan_id", "row_idx").agg(F.min("y1").alias("ry1"), F.max("y2").alias("ry2"))
    spans = d.fac.where("ln = 2").groupBy("scan_id", "y1", "y2").agg(F.min("pos").alias("fpos"))
    cy = (F.col("ry1") + F.col("ry2")) / 2.0
    ov = F.greatest(F.lit(0), F.least("ry2", "y2") - F.greatest("ry1", "y1")) / F.greatest(
        F.lit(1), F.least(F.col("ry2") - F.col("ry1"), F.col("y2") - F.col("y1")))
    inside = (F.col("y1") <= cy) & (cy <= F.col("y2"))
    key = F.struct(F.when(inside, 0).when(ov >= 0.15, 1).otherwise(2).alias("c"),
                   F.when(inside, -ov).otherwise(F.abs(cy - (F.col("y1") + F.col("y2")) / 2.0)).alias("k"), F.col("fpos").alias("p"))
    return rows.join(spans, "scan_id").groupBy("scan_id", "row_idx").agg(F.min(key).alias("m")).select("scan_id", "row_idx", F.col("m.p").alias("pos"))
