"""SQL counterparts of sequential rules: a walk over ranked rows with the used rows as state."""

from __future__ import annotations


def greedy_walk(pairs: str, order: str, prefix: str) -> dict[str, str]:
    """Table expressions ending in ``{prefix}_chosen(g, l, r)`` for pairs (g, l, r, …) taken in order."""
    return {
        f"{prefix}_rk": f"SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}, l, r) AS rn FROM {pairs}",
        f"{prefix}_walk": f"""/*recursive*/ SELECT g, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ul, CAST([] AS BIGINT[]) AS ur, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r
            FROM (SELECT DISTINCT g FROM {prefix}_rk)
            UNION ALL SELECT w.g, k.rn, CASE WHEN NOT list_contains(w.ul, k.l) AND NOT list_contains(w.ur, k.r) THEN list_append(w.ul, k.l) ELSE w.ul END,
              CASE WHEN NOT list_contains(w.ul, k.l) AND NOT list_contains(w.ur, k.r) THEN list_append(w.ur, k.r) ELSE w.ur END,
              CASE WHEN NOT list_contains(w.ul, k.l) AND NOT list_contains(w.ur, k.r) THEN k.l END,
              CASE WHEN NOT list_contains(w.ul, k.l) AND NOT list_contains(w.ur, k.r) THEN k.r END
            FROM {prefix}_walk w JOIN {prefix}_rk k ON k.g = w.g AND k.rn = w.rn + 1""",
        f"{prefix}_chosen": f"SELECT g, l, r FROM {prefix}_walk WHERE l IS NOT NULL",
    }


def keep_walk(nodes: str, edges: str, order: str, prefix: str) -> dict[str, str]:
    """``{prefix}_kept(g, id)`` of a keep-first rule over nodes (g, id, …) and edges (g, hi, lo)."""
    return {
        f"{prefix}_rk": f"""SELECT n.g, n.id, row_number() OVER (PARTITION BY n.g ORDER BY {order}) AS rn, coalesce(e.his, CAST([] AS BIGINT[])) AS his
            FROM {nodes} n LEFT JOIN (SELECT g, lo, list(CAST(hi AS BIGINT)) AS his FROM {edges} GROUP BY g, lo) e ON n.g = e.g AND n.id = e.lo""",
        f"{prefix}_walk": f"""/*recursive*/ SELECT g, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS id FROM (SELECT DISTINCT g FROM {prefix}_rk)
            UNION ALL SELECT w.g, k.rn, CASE WHEN list_has_any(k.his, w.kept) THEN w.kept ELSE list_append(w.kept, k.id) END, CASE WHEN list_has_any(k.his, w.kept) THEN NULL ELSE k.id END
            FROM {prefix}_walk w JOIN {prefix}_rk k ON k.g = w.g AND k.rn = w.rn + 1""",
        f"{prefix}_kept": f"SELECT g, id FROM {prefix}_walk WHERE id IS NOT NULL",
    }


def area(p: str) -> str:
    return f"(greatest({p}.x2 - {p}.x1, 0) * greatest({p}.y2 - {p}.y1, 0))"


def inter(a: str, b: str) -> str:
    return (f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) "
            f"* greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))")


def iou(a: str, b: str) -> str:
    return f"(CAST({inter(a, b)} AS DOUBLE) / ({area(a)} + {area(b)} - {inter(a, b)}))"


def same_row(a: str, b: str) -> str:
    return f"(abs(({a}.y1 + {a}.y2) / 2.0e0 - ({b}.y1 + {b}.y2) / 2.0e0) <= greatest({a}.y2 - {a}.y1, {b}.y2 - {b}.y1) * 0.55e0)"


def x_over(a: str, b: str) -> str:
    return (f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) / "
            f"CAST(least({a}.x2 - {a}.x1, {b}.x2 - {b}.x1) AS DOUBLE))")


def same_band(a: str, b: str) -> str:
    return (f"({x_over(a, b)} >= 0.28e0 OR abs(({a}.x1 + {a}.x2) / 2.0e0 - ({b}.x1 + {b}.x2) / 2.0e0) "
            f"<= least({a}.x2 - {a}.x1, {b}.x2 - {b}.x1) * 0.38e0)")


def cap(i: str, o: str) -> str:
    return (f"(({i}.y1 + {i}.y2) / 2.0e0 <= {o}.y1 + ({o}.y2 - {o}.y1) * 0.48e0 AND {x_over(i, o)} >= 0.30e0 "
            f"AND CAST({area(i)} AS DOUBLE) / {area(o)} <= 0.55e0)")
