"""Queries: columns and rows with running state, row allocation, slot assignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwright.operators import boxes as B
from shelfwright.operators import text_match as TM
from shelfwright.operators.matching import greedy_one_to_one
from shelfwright.plans import boxes as PB
from shelfwright.plans import sqlkit as S
from shelfwright.plans.registry import query

c = F.col
UC = {
    "sp": "SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY xc, x1) AS rn FROM (SELECT DISTINCT scan_id, CAST(x1 AS DOUBLE) AS x1, CAST(x2 AS DOUBLE) AS x2, (x1 + x2) / 2.0e0 AS xc FROM fac)",
    "uw": """/*recursive*/ SELECT scan_id, rn, x1, x2, x1 AS u1, x2 AS u2, 0 AS col_idx FROM sp WHERE rn = 1
        UNION ALL SELECT s.scan_id, s.rn, s.x1, s.x2, CASE WHEN j.same THEN least(w.u1, s.x1) ELSE s.x1 END, CASE WHEN j.same THEN greatest(w.u2, s.x2) ELSE s.x2 END, CASE WHEN j.same THEN w.col_idx ELSE w.col_idx + 1 END
        FROM uw w JOIN sp s ON s.scan_id = w.scan_id AND s.rn = w.rn + 1, LATERAL (SELECT abs((w.u1 + w.u2) / 2 - s.xc) <= least(w.u2 - w.u1, s.x2 - s.x1) * 0.38e0 OR (least(w.u2, s.x2) - greatest(w.u1, s.x1) > 0 AND (least(w.u2, s.x2) - greatest(w.u1, s.x1)) / least(w.u2 - w.u1, s.x2 - s.x1) >= 0.28e0) AS same) j""",
}


@query("w8_union_columns", "SELECT f.scan_id, f.pos, u.col_idx FROM fac f JOIN uw u ON f.scan_id = u.scan_id AND f.x1 = u.x1 AND f.x2 = u.x2", UC)
def w8(d):
    return B.union_columns(d.fac).select("scan_id", "pos", "col_idx")


MR = {
    "lv": """SELECT f.scan_id, f.cy, f.n, greatest(m.med_h * 0.45e0, m.y2_first * 0.08e0) AS tol, row_number() OVER (PARTITION BY f.scan_id ORDER BY f.cy) AS rn FROM (SELECT scan_id, (y1 + y2) / 2.0e0 AS cy, count(*) AS n FROM fac GROUP BY ALL) f
        JOIN (SELECT scan_id, list_sort(list(y2 - y1))[CAST(floor(count(*) / 2) AS INT) + 1] AS med_h, arg_min(y2, pos) AS y2_first FROM fac GROUP BY scan_id) m ON f.scan_id = m.scan_id""",
    "rw": """/*recursive*/ SELECT scan_id, rn, cy, [cy * n] AS tot, [CAST(n AS DOUBLE)] AS cnt, 0 AS row_idx FROM lv WHERE rn = 1
        UNION ALL SELECT l.scan_id, l.rn, l.cy, CASE WHEN h.i IS NULL THEN list_append(w.tot, l.cy * l.n) ELSE list_transform(w.tot, lambda x, k: CASE WHEN k = h.i THEN x + l.cy * l.n ELSE x END) END,
          CASE WHEN h.i IS NULL THEN list_append(w.cnt, CAST(l.n AS DOUBLE)) ELSE list_transform(w.cnt, lambda x, k: CASE WHEN k = h.i THEN x + l.n ELSE x END) END, coalesce(h.i, len(w.tot) + 1) - 1
        FROM rw w JOIN lv l ON l.scan_id = w.scan_id AND l.rn = w.rn + 1, LATERAL (SELECT list_filter(range(1, len(w.tot) + 1), lambda k: abs(l.cy - w.tot[k] / w.cnt[k]) <= l.tol)[1] AS i) h""",
}


@query("w12_mean_rows", "SELECT f.scan_id, f.pos, r.row_idx FROM fac f JOIN rw r ON f.scan_id = r.scan_id AND (f.y1 + f.y2) / 2.0e0 = r.cy", MR)
def w12(d):
    return B.mean_rows(d.fac).select("scan_id", "pos", "row_idx")


AL = {
    **PB.ROWS,
    "nr": "SELECT scan_id, max(row_idx) + 1 AS rows FROM rows1 GROUP BY scan_id",
    "wt": "SELECT scan_id // 8 AS scan_id, pos * 8 + scan_id % 8 AS pos, greatest(1, expected_qty) AS weight FROM plan",
    "wr": "SELECT w.*, n.rows, count(*) OVER (PARTITION BY w.scan_id) AS skus, sum(weight) OVER (PARTITION BY w.scan_id) AS total, row_number() OVER (PARTITION BY w.scan_id ORDER BY pos) AS rn FROM wt w JOIN nr n ON w.scan_id = n.scan_id",
    "aw": """/*recursive*/ SELECT scan_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS pos, CAST(0 AS BIGINT) AS span, CAST(0 AS BIGINT) AS last_row FROM (SELECT DISTINCT scan_id FROM wr)
        UNION ALL SELECT r.scan_id, r.rn, r.pos, s.n, w.last_row + s.n FROM aw w JOIN wr r ON r.scan_id = w.scan_id AND r.rn = w.rn + 1, LATERAL (SELECT CAST(CASE WHEN r.rows <= r.skus THEN CASE WHEN w.rn < r.rows THEN 1 ELSE 0 END WHEN r.rn = r.skus THEN r.rows - w.last_row
          ELSE least(greatest(1, round_even(CAST((r.rows - w.last_row) * r.weight AS DOUBLE) / r.total, 0)), greatest(1, r.rows - w.last_row - (r.skus - r.rn))) END AS BIGINT) AS n) s""",
    "qr": "SELECT a.scan_id, a.pos, a.span, coalesce(sum(k.n), 0) AS quantity FROM aw a LEFT JOIN (SELECT scan_id, row_idx, count(*) AS n FROM rows1 GROUP BY ALL) k ON a.scan_id = k.scan_id AND k.row_idx >= a.last_row - a.span AND k.row_idx < a.last_row WHERE a.pos IS NOT NULL GROUP BY ALL",
}


def _weights(d):
    p = d.plan
    return p.select(F.floor(c("scan_id") / 8).alias("scan_id"), (c("pos") * 8 + c("scan_id") % 8).alias("pos"), c("expected_qty").alias("weight"))


def _spans(d):
    rows = B.shelf_rows(d.fac)
    n = rows.groupBy("scan_id").agg((F.max("row_idx") + 1).alias("rows"))
    return B.allocate_rows(_weights(d), n), rows


@query("f25_row_allocation", "SELECT scan_id, pos, span, last_row FROM aw WHERE pos IS NOT NULL", AL)
def f25(d):
    return _spans(d)[0]


@query("f26_quantity_from_rows", """SELECT scan_id, pos, span, quantity + CASE WHEN hit THEN extra ELSE 0 END AS quantity, hit AS imputed FROM (SELECT q.*, w.weight, span > 0 AND quantity < w.weight * 9 AND CAST(round_even(quantity / nullif(span, 0) * 1, 0) AS BIGINT) > 0 AS hit, CAST(round_even(quantity / nullif(span, 0) * 1, 0) AS BIGINT) AS extra FROM qr q JOIN wt w ON q.scan_id = w.scan_id AND q.pos = w.pos)""", AL)
def f26(d):
    spans, rows = _spans(d)
    counts = rows.groupBy("scan_id", "row_idx").agg(F.count("*").alias("facings"))
    q = B.quantity_from_rows(spans, counts).join(_weights(d), ["scan_id", "pos"])
    q = q.withColumns({"ideal_span": c("span") + 1, "expected_qty": F.greatest(F.lit(1), "weight") * 9})
    return B.impute_quantity(q).select("scan_id", "pos", "span", "quantity", "imputed")


SLOT = {
    "sl": "SELECT scan_id, pos, lower(pack_text) AS t, row_number() OVER (PARTITION BY scan_id ORDER BY x1 + x2, pos) - 1 AS rk, count(*) OVER (PARTITION BY scan_id) AS ns FROM fac WHERE pack_text <> ''",
    "cd": "SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ppos) - 1 AS ci, count(*) OVER (PARTITION BY scan_id) AS nc FROM (SELECT scan_id // 8 AS scan_id, pos * 8 + scan_id % 8 AS ppos, lower(brand) AS b, lower(product_name) AS n, sub_category AS s FROM plan)",
    "ss": """SELECT f.scan_id AS g, f.pos AS l, p.ppos AS r, CASE WHEN contains(f.t, p.b) THEN least(1.0e0, 1.0e0 * 0.55e0 + len(list_intersect(list_distinct(string_split(p.n, ' ')), list_distinct(string_split(f.t, ' ')))) / CAST(greatest(len(list_distinct(string_split(p.n, ' '))), len(list_distinct(string_split(f.t, ' ')))) AS DOUBLE) * 0.33e0
        + CASE WHEN contains(f.t, p.s) THEN 0.12e0 ELSE 0.0e0 END + least(0.35e0, len(list_filter(string_split(p.n, ' '), lambda w: length(w) >= 4 AND contains(f.t, w))) * 0.08e0)) ELSE 0.0e0 END AS score FROM sl f JOIN cd p ON f.scan_id = p.scan_id""",
    "s22": "SELECT * FROM ss WHERE score >= 0.22e0",
    **S.greedy_walk("s22", "score DESC", "slt"),
    "back": """SELECT f.scan_id AS g, f.pos AS l, p.ppos AS r FROM sl f JOIN cd p ON f.scan_id = p.scan_id AND f.rk = p.ci WHERE ns = nc AND ns >= 2 AND NOT EXISTS (SELECT 1 FROM slt_chosen x WHERE x.g = f.scan_id AND x.l = f.pos) AND NOT EXISTS (SELECT 1 FROM slt_chosen x WHERE x.g = f.scan_id AND x.r = p.ppos)""",
}


@query("j24_slot_assignment", "SELECT g AS scan_id, l AS pos, r AS ppos, 'text' AS how FROM slt_chosen UNION ALL SELECT g, l, r, 'position' FROM back", SLOT)
def j24(d):
    """Slots to planned rows by text score, the rest by place where both sides have equal length."""
    from shelfwright.operators.planogram_match import related_brands

    w = Window.partitionBy("scan_id")
    f = d.fac.where("pack_text <> ''").select("scan_id", "pos", F.lower("pack_text").alias("t"), (c("x1") + c("x2")).alias("x"))
    p = d.plan.select(F.floor(c("scan_id") / 8).alias("scan_id"), (c("pos") * 8 + c("scan_id") % 8).alias("ppos"), F.lower("brand").alias("b"), F.lower("product_name").alias("n"), c("sub_category").alias("s"))
    brands = d.table("part").select(F.lower("p_brand").alias("bk")).distinct()
    named = related_brands(f.select(c("t").alias("bk")), brands).select(c("a").alias("t"), "b")
    pairs = f.join(named, "t").join(p, ["scan_id", "b"]).withColumn("score", TM.candidate_score(c("t"), c("b"), c("n"), c("s"))).where("score >= 0.22")
    taken = greedy_one_to_one(pairs, "scan_id", "pos", "ppos", [-c("score")]).select("scan_id", "pos", "ppos")
    slots = f.select("scan_id", "pos", (F.row_number().over(w.orderBy("x", "pos")) - 1).alias("rk"), F.count("*").over(w).alias("n"))
    cands = p.select("scan_id", "ppos", (F.row_number().over(w.orderBy("ppos")) - 1).alias("rk"), F.count("*").over(w).alias("n"))
    rest = slots.where("n >= 2").join(cands, ["scan_id", "rk", "n"]).join(taken.select("scan_id", "pos"), ["scan_id", "pos"], "left_anti").join(
        taken.select("scan_id", "ppos"), ["scan_id", "ppos"], "left_anti")
    return taken.withColumn("how", F.lit("text")).unionByName(rest.select("scan_id", "pos", "ppos", F.lit("position").alias("how")))
