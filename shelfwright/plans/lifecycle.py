"""Queries: findings, schedules, reminders, hierarchy, expiry, usage, data-quality checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwright.functions import schedule as S
from shelfwright.operators import lifecycle as LC
from shelfwright.operators import slices
from shelfwright.plans.registry import query

NOW_TEXT = "1998-06-01 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


VAR = {
    "var": """SELECT *, actual_qty - expected_qty AS variance_qty, CAST(CASE WHEN actual_qty IS NULL THEN NULL WHEN expected_qty > 0 THEN round(CAST(actual_qty - expected_qty AS DECIMAL(20,6)) * 100 / expected_qty, 2) WHEN actual_qty = 0 THEN 0 ELSE 100 END AS DOUBLE) AS variance_pct,
        CAST(round((actual_qty - expected_qty) * CAST(mrp_inr AS DECIMAL(12,2)), 2) AS DOUBLE) AS variance_value_inr FROM audit""",
    "fnd": """SELECT *, CASE WHEN actual_qty = 0 AND expected_qty > 0 THEN 'out_of_stock' WHEN variance_qty < 0 THEN 'inventory_shortage' ELSE 'inventory_excess' END AS finding_type,
        CASE WHEN (actual_qty = 0 AND expected_qty > 0) OR abs(coalesce(variance_value_inr, 0)) >= 10000 THEN 'critical' WHEN abs(variance_qty) >= 10 THEN 'high' WHEN abs(variance_qty) >= 3 THEN 'medium' ELSE 'low' END AS severity
        FROM var WHERE coalesce(variance_qty, 0) <> 0""",
}


@query("f4_digital_variance", "SELECT assignment_id, pos, variance_qty, variance_pct, variance_value_inr FROM var", VAR)
def f4(d):
    return LC.with_variance(d.audit).select("assignment_id", "pos", "variance_qty", "variance_pct", "variance_value_inr")


@query("r5_variance_findings", f"""SELECT assignment_id, pos, finding_type, severity, {NOW_SQL} + to_hours(CAST(CASE WHEN store_id % 7 = 3 AND severity = 'high' THEN 6 ELSE CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 12 WHEN 'medium' THEN 24 ELSE 72 END END AS INT)) AS due_at
    FROM fnd WHERE ln <> 1""", VAR)
def r5(d):
    lines = d.audit.withColumn("org_id", F.col("store_id") % 7)
    sla = d.table("region").where("r_regionkey = 3").select(F.col("r_regionkey").cast("bigint").alias("org_id"), F.lit("high").alias("severity"), F.lit(6).alias("sla_hours"))
    known = d.audit.where("ln = 1").select("assignment_id", "pos")
    return LC.variance_findings(lines, sla, known, now()).select("assignment_id", "pos", "finding_type", "severity", "due_at")


@query("f17_sla_due", f"SELECT scan_id, {NOW_SQL} + to_hours(CAST(CASE priority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 12 WHEN '3-MEDIUM' THEN 24 ELSE 72 END AS INT)) AS due_at FROM scans")
def f17(d):
    sev = F.lower(F.regexp_replace("priority", "^1-URGENT$", "x-critical")).substr(3, 20)
    return d.scans.select("scan_id", (now() + S.hours(S.sla_hours(sev))).alias("due_at"))


@query("r6_line_findings", """SELECT scan_id, pos, CASE issue_type WHEN 'missing' THEN 'missing_product' WHEN 'wrong_product' THEN 'wrong_placement' WHEN 'wrong_location' THEN 'wrong_placement' WHEN 'qty_mismatch' THEN CASE WHEN actual_qty = 0 THEN 'out_of_stock' ELSE 'planogram_violation' END ELSE 'shelf_execution_issue' END AS finding_type,
    CASE WHEN issue_type = 'missing' THEN 'critical' ELSE 'high' END AS severity, actual_qty - coalesce(expected_qty, 0) AS variance_units FROM lines WHERE coalesce(issue_type, '') <> 'correct' AND ln <> 2""")
def r6(d):
    lines = d.lines.withColumn("severity", F.when(F.col("issue_type") == "missing", "critical").otherwise("warning"))
    return LC.line_findings(lines, d.lines.where("ln = 2").select("scan_id", "pos"))


@query("u6_idempotent_insert", "SELECT scan_id, pos FROM lines WHERE ln IN (1, 2) UNION SELECT scan_id, pos FROM lines WHERE ln IN (2, 3)")
def u6(d):
    """A second load of overlapping rows adds only the new keys."""
    first, second = d.lines.where("ln IN (1, 2)").select("scan_id", "pos"), d.lines.where("ln IN (2, 3)").select("scan_id", "pos")
    return first.unionByName(second.join(first, ["scan_id", "pos"], "left_anti"))


@query("r7_overdue_actions", f"SELECT assignment_id, CASE WHEN due_at < {NOW_SQL} AND status = 'in_progress' THEN 'overdue' ELSE status END AS status FROM asg")
def r7(d):
    return LC.mark_overdue(d.asg, now()).select("assignment_id", "status")


NEXT = """CASE cadence WHEN 'daily' THEN CASE WHEN dd + to_days(1) + to_hours(8) <= t THEN dd + to_days(2) + to_hours(8) ELSE dd + to_days(1) + to_hours(8) END
    WHEN 'weekly' THEN dd + to_days(CAST((day_of_week - dayofweek(t) + 7) % 7 + 1 AS INT)) + to_hours(8)
    WHEN 'monthly' THEN date_trunc('month', t) + to_months(1) + to_days(least(day_of_month, 28) - 1) + to_hours(8) ELSE t + to_days(7) END"""
SCH = {
    "due": f"""SELECT *, strftime(next_run_at + CASE WHEN tz = 'Asia/Kolkata' THEN INTERVAL '330 minutes' ELSE INTERVAL '0 minutes' END, '%Y-%m-%dT%H:%M') AS occurrence_key, next_run_at + to_hours(CASE WHEN schedule_id % 6 = 0 THEN 36 ELSE 24 END) AS due_at
        FROM sched WHERE active AND next_run_at <= {NOW_SQL} AND (max_occurrences IS NULL OR occurrence_count < max_occurrences) AND NOT (schedule_id % 10 = 0 AND coalesce(tz, '') = 'Asia/Kolkata')""",
}


def _due(d):
    occ = d.sched.where("schedule_id % 10 = 0 AND tz = 'Asia/Kolkata'").select("schedule_id", S.occurrence_key(F.col("next_run_at"), F.col("tz")).alias("occurrence_key"))
    return LC.due_schedules(d.sched, occ, now())


@query("f16_next_run", f"SELECT schedule_id, {NEXT} AS next_at FROM (SELECT *, next_run_at AS t, date_trunc('day', next_run_at) AS dd FROM sched)")
def f16(d):
    return d.sched.select("schedule_id", S.next_run(F.col("cadence"), F.col("day_of_week"), F.col("day_of_month"), F.col("next_run_at")).alias("next_at"))


@query("f18_occurrence_key", "SELECT schedule_id, strftime(next_run_at + CASE WHEN tz = 'Asia/Kolkata' THEN INTERVAL '330 minutes' ELSE INTERVAL '0 minutes' END, '%Y-%m-%dT%H:%M') AS occurrence_key FROM sched")
def f18(d):
    return d.sched.select("schedule_id", S.occurrence_key(F.col("next_run_at"), F.col("tz")).alias("occurrence_key"))


@query("r8_due_schedules", "SELECT schedule_id, occurrence_key, due_at FROM due", SCH)
def r8(d):
    return _due(d).select("schedule_id", "occurrence_key", "due_at")


@query("w4_round_robin_assignments", """SELECT schedule_id, occurrence_key, store_id + i AS store_id, CASE WHEN i % 2 = 0 THEN assignee_id ELSE assignee_id + 100 END AS assignee_id, due_at
    FROM due, LATERAL (SELECT unnest(range(0, 1 + schedule_id % 4)) AS i) r""", SCH)
def w4(d):
    due = _due(d).withColumns({
        "store_ids": F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("schedule_id") % 4), lambda i: F.col("store_id") + i),
        "assignee_ids": F.array("assignee_id", F.col("assignee_id") + 100)})
    return LC.schedule_assignments(due)


@query("r8_advance_schedules", f"""SELECT schedule_id, occurrence_count + 1 AS occurrence_count, CASE WHEN assignment_mode <> 'schedule_once' THEN {NEXT} END AS next_run_at,
    CASE WHEN assignment_mode = 'schedule_once' OR (max_occurrences IS NOT NULL AND occurrence_count + 1 >= max_occurrences) THEN 'completed' ELSE 'active' END AS status
    FROM (SELECT *, {NOW_SQL} + INTERVAL '1 minute' AS t, date_trunc('day', {NOW_SQL}) AS dd FROM due)""", SCH)
def r8b(d):
    return LC.advance_schedules(_due(d), now())


@query("r9_reminders", f"""SELECT assignment_id, reminder_type, hours, user_id FROM (
    SELECT assignment_id, 'overdue' AS reminder_type, CAST(NULL AS INT) AS hours, assignee_id AS user_id FROM asg WHERE status <> 'completed' AND due_at > {NOW_SQL} - to_days(7) AND due_at < {NOW_SQL}
    UNION ALL SELECT assignment_id, 'escalation', NULL, 900 + org_id FROM asg WHERE status <> 'completed' AND due_at > {NOW_SQL} - to_days(7) AND due_at < {NOW_SQL} AND org_id IN (1, 2)
    UNION ALL SELECT assignment_id, 'due_soon', h, assignee_id FROM asg, LATERAL (SELECT unnest(CASE WHEN org_id IN (1, 2) THEN [48, 8, 2] ELSE [24, 12, 4, 1] END) AS h) WHERE status <> 'completed' AND due_at >= {NOW_SQL} AND due_at <= {NOW_SQL} + to_hours(h) AND due_at > {NOW_SQL} + to_hours(h - 1))
    WHERE NOT (reminder_type = 'overdue' AND assignment_id % 5 = 0)""")
def r9(d):
    settings = d.table("region").where("r_regionkey IN (1, 2)").select(F.col("r_regionkey").cast("bigint").alias("org_id"), F.array(F.lit(48), F.lit(8), F.lit(2)).alias("reminder_hours"),
                                                                    (F.col("r_regionkey").cast("bigint") + 900).alias("escalation_user_id"))
    sent = d.asg.where("assignment_id % 5 = 0").select("assignment_id", F.lit("overdue").alias("reminder_type"), F.lit(None).cast("int").alias("hours"))
    return LC.reminders(d.asg, settings, sent, now())


@query("r10_notify_roles", """SELECT n_nationkey AS notice_id, CAST(n_regionkey AS BIGINT) AS org_id, c_custkey AS user_id FROM nation JOIN customer ON c_nationkey % 5 = n_regionkey
    WHERE c_acctbal > 0 AND lower(c_mktsegment) IN (CASE WHEN n_nationkey % 2 = 0 THEN 'building' ELSE 'machinery' END, 'household')""")
def r10(d):
    members = d.table("customer").select((F.col("c_nationkey") % 5).cast("bigint").alias("org_id"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"),
                                          F.when(F.col("c_acctbal") > 0, "active").otherwise("left").alias("status"))
    notices = d.table("nation").select(F.col("n_nationkey").alias("notice_id"), F.col("n_regionkey").cast("bigint").alias("org_id"),
                                        F.array(F.when(F.col("n_nationkey") % 2 == 0, "building").otherwise("machinery"), F.lit("household")).alias("roles"))
    return LC.members_by_role(members, notices)


HIER = {
    "nodes": """SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, 'region' AS level, CAST(NULL AS BIGINT) AS ext FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'sales_rep', n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'outlet', c_custkey FROM customer""",
    "tree": """/*recursive*/ SELECT id, level, ext, CAST(NULL AS BIGINT) AS rep FROM nodes WHERE id = 'r1' UNION ALL SELECT c.id, c.level, c.ext, CASE WHEN c.level = 'sales_rep' THEN c.ext ELSE p.rep END FROM nodes c JOIN tree p ON c.parent_id = p.id""",
}
TREE_SPARK = """WITH RECURSIVE tree AS (SELECT id, level, ext, CAST(NULL AS BIGINT) AS rep FROM {nodes} WHERE id = 'r1'
    UNION ALL SELECT c.id, c.level, c.ext, CASE WHEN c.level = 'sales_rep' THEN c.ext ELSE p.rep END FROM {nodes} c JOIN tree p ON c.parent_id = p.id)"""


def _nodes(d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None)
    return d.table("region").select(s("r", "r_regionkey").alias("id"), none.cast("string").alias("parent_id"), F.lit("region").alias("level"), none.cast("bigint").alias("ext")).unionByName(
        d.table("nation").select(s("n", "n_nationkey").alias("id"), s("r", "n_regionkey").alias("parent_id"), F.lit("sales_rep").alias("level"), F.col("n_nationkey").cast("bigint").alias("ext"))).unionByName(
        d.table("customer").select(s("c", "c_custkey").alias("id"), s("n", "c_nationkey").alias("parent_id"), F.lit("outlet").alias("level"), F.col("c_custkey").alias("ext")))


@query("r11_hierarchy_outlets", "SELECT ext AS store_id, id AS node_id, rep AS sales_rep_id FROM tree WHERE level = 'outlet'", HIER)
def r11(d):
    return d.spark.sql(TREE_SPARK + " SELECT ext AS store_id, id AS node_id, rep AS sales_rep_id FROM tree WHERE level = 'outlet'", nodes=_nodes(d))


@query("r12_hierarchy_assignees", """SELECT t.id AS node_id, s_suppkey AS user_id FROM tree t JOIN supplier ON s_nationkey = t.ext WHERE t.level = 'sales_rep' AND s_acctbal > 0""", HIER)
def r12(d):
    members = d.table("supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("ext"))
    tree = d.spark.sql(TREE_SPARK + " SELECT id AS node_id, ext FROM tree WHERE level = 'sales_rep'", nodes=_nodes(d))
    return tree.join(members, "ext").select("node_id", F.col("s_suppkey").alias("user_id"))


EXP = {
    "last_pkt": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id, packet_ordinal ORDER BY ts DESC, pos DESC) AS rn FROM pkt WHERE NOT (unreadable AND classification = 'sellable')) WHERE rn = 1""",
    "cnt": """SELECT attempt_id, count(*) FILTER (classification = 'sellable') AS sellable, count(*) FILTER (classification IN ('expired', 'near_expiry')) AS remove, count(*) FILTER (classification = 'unresolved') AS unresolved,
        count(*) FILTER (classification = 'expired') AS expired, count(*) AS observations FROM last_pkt GROUP BY attempt_id""",
    "att": """SELECT scan_id AS attempt_id, org_id, store_id, CAST(amount AS BIGINT) % 9 AS expected_quantity, CASE WHEN scan_id % 4 = 0 THEN NULL ELSE scan_id % 5 END AS physical_count, CASE WHEN scan_id % 4 = 0 THEN NULL ELSE scan_id % 9 END AS actual_quantity,
        CASE status WHEN 'F' THEN 'reported_removed' WHEN 'O' THEN 'required' ELSE 'received_quarantine' END AS removal_status, CASE priority WHEN '1-URGENT' THEN 'assigned' WHEN '2-HIGH' THEN 'in_progress' WHEN '3-MEDIUM' THEN 'submitted' ELSE 'closed' END AS inspection_status,
        scan_ts AS due_at FROM scans""".replace("CAST(amount AS BIGINT) % 9", "CAST(floor(amount) AS BIGINT) % 9"),
}


def _attempts(d):
    k = F.col("scan_id")
    return d.scans.select(
        k.alias("attempt_id"), "org_id", "store_id", (F.floor("amount") % 9).alias("expected_quantity"), F.when(k % 4 != 0, k % 5).alias("physical_count"), F.when(k % 4 != 0, k % 9).alias("actual_quantity"),
        F.when(F.col("status") == "F", "reported_removed").when(F.col("status") == "O", "required").otherwise("received_quarantine").alias("removal_status"),
        F.when(F.col("priority") == "1-URGENT", "assigned").when(F.col("priority") == "2-HIGH", "in_progress").when(F.col("priority") == "3-MEDIUM", "submitted").otherwise("closed").alias("inspection_status"),
        F.col("scan_ts").alias("due_at"))


@query("r14_expiry_replay", "SELECT attempt_id, packet_ordinal, classification, unreadable, store_id, file_hash FROM last_pkt", EXP)
def r14(d):
    return LC.replay_observations(d.pkt)


@query("g58_expiry_reconciliation", """SELECT a.attempt_id, physical_count, coalesce(physical_count = sellable + remove + unresolved AND observations = physical_count, false) AS reconciled FROM att a LEFT JOIN cnt c ON a.attempt_id = c.attempt_id""", EXP)
def g58(d):
    return LC.reconciliation(_attempts(d), LC.expiry_counts(LC.replay_observations(d.pkt)))


@query("r13_expiry_exceptions", """SELECT attempt_id, issue_type, severity, sort_priority, quantity FROM (
    SELECT a.attempt_id, 'expired_not_quarantined' AS issue_type, 'critical' AS severity, 1 AS sort_priority, expired AS quantity FROM att a JOIN cnt c ON a.attempt_id = c.attempt_id WHERE expired > 0 AND removal_status = 'required'
    UNION ALL SELECT a.attempt_id, 'unresolved_not_held', 'high', 2, unresolved FROM att a JOIN cnt c ON a.attempt_id = c.attempt_id WHERE unresolved > 0
    UNION ALL SELECT attempt_id, 'quantity_mismatch', 'high', 4, abs(actual_quantity - expected_quantity) FROM att WHERE actual_quantity <> expected_quantity) WHERE NOT (issue_type = 'unresolved_not_held' AND attempt_id % 3 = 0)""", EXP)
def r13(d):
    open_now = d.scans.where("scan_id % 3 = 0").select(F.col("scan_id").alias("attempt_id"), F.lit("unresolved_not_held").alias("issue_type"))
    return LC.expiry_exceptions(_attempts(d), LC.expiry_counts(LC.replay_observations(d.pkt)), open_now)


@query("g59_expiry_overview", f"""SELECT org_id, store_id, sum(CASE WHEN inspection_status IN ('assigned', 'in_progress', 'submitted') THEN expected_quantity ELSE 0 END) AS units_in_scope, count(*) FILTER (c = 'expired') AS expired_detected, count(*) FILTER (c = 'near_expiry') AS near_expiry,
    count(*) FILTER (c = 'unresolved' OR u) AS unresolved_dates, count(*) FILTER (removal_status = 'reported_removed') AS awaiting_removal, count(*) FILTER (removal_status = 'received_quarantine') AS in_quarantine,
    count(*) FILTER (due_at < {NOW_SQL} AND inspection_status IN ('assigned', 'in_progress')) AS overdue_inspections FROM (
    SELECT org_id, store_id, expected_quantity, inspection_status, removal_status, due_at, NULL AS c, NULL AS u FROM att UNION ALL SELECT a.org_id, a.store_id, NULL, NULL, NULL, NULL, p.classification, p.unreadable FROM pkt p JOIN att a ON p.attempt_id = a.attempt_id)
    GROUP BY GROUPING SETS ((org_id), (org_id, store_id))""", EXP)
def g59(d):
    return LC.expiry_overview(_attempts(d), d.pkt, now())


@query("r15_locked_edits", """SELECT record_id, version FROM (SELECT *, lag(version) OVER w AS pv, lag(actual_qty) OVER w AS pq, lag(rca_code) OVER w AS pr FROM (
    SELECT sku AS record_id, assignment_id * 10 + ln AS version, max(actual_qty) AS actual_qty, max(rca_code) AS rca_code, CASE WHEN (assignment_id * 10 + ln) % 3 = 0 THEN 'draft' ELSE 'approved' END AS status, CASE WHEN (assignment_id * 10 + ln) % 4 = 0 THEN 'manager_edit' END AS source FROM audit GROUP BY 1, 2, assignment_id, ln)
    WINDOW w AS (PARTITION BY record_id ORDER BY version)) WHERE pv IS NOT NULL AND status = 'approved' AND source IS NULL AND (actual_qty IS DISTINCT FROM pq OR rca_code IS DISTINCT FROM pr)""")
def r15(d):
    v = d.audit.groupBy(F.col("sku").alias("record_id"), (F.col("assignment_id") * 10 + F.col("ln")).alias("version")).agg(F.max("actual_qty").alias("actual_qty"), F.max("rca_code").alias("rca_code"))
    v = v.withColumns({"status": F.when(F.col("version") % 3 == 0, "draft").otherwise("approved"), "source": F.when(F.col("version") % 4 == 0, "manager_edit")})
    return LC.locked_edits(v)


@query("r16_template_versions", """SELECT org_id AS template_id, event_id, row_number() OVER (PARTITION BY org_id ORDER BY ts, event_id) AS version, '{"template_id":' || org_id || ',"name":"' || 'T' || org_id || '"}' AS snapshot FROM ev WHERE event_type = 'signup'""")
def r16(d):
    e = d.ev.where("event_type = 'signup'").select(F.col("org_id").alias("template_id"), "event_id", "ts", F.concat(F.lit("T"), F.col("org_id").cast("string")).alias("name"))
    return LC.publish_versions(e)


ALLOW = {
    "pur": "SELECT org_id, ts, row_number() OVER (PARTITION BY org_id ORDER BY ts) AS rn FROM ev WHERE event_type = 'purchase'",
    "awalk": """/*recursive*/ SELECT org_id, CAST(0 AS BIGINT) AS rn, 0 AS n, CAST(NULL AS TIMESTAMP) AS start, false AS blocked FROM (SELECT DISTINCT org_id FROM pur)
        UNION ALL SELECT w.org_id, p.rn, CASE WHEN w.blocked OR p.ts < w.start THEN w.n WHEN w.n + 1 = 5 THEN CASE WHEN TIMESTAMP '2024-01-30 12:00:00' < p.ts + to_hours(24) THEN 5 ELSE 0 END ELSE w.n + 1 END,
        CASE WHEN w.blocked OR p.ts < w.start OR w.n + 1 < 5 THEN w.start ELSE p.ts + to_hours(24) END, w.blocked OR (NOT coalesce(p.ts < w.start, false) AND w.n + 1 = 5 AND TIMESTAMP '2024-01-30 12:00:00' < p.ts + to_hours(24))
        FROM awalk w JOIN pur p ON p.org_id = w.org_id AND p.rn = w.rn + 1""",
}


@query("r17_rolling_allowance", "SELECT org_id, arg_max(n, rn) AS used, arg_max(blocked, rn) AS blocked, CASE WHEN arg_max(blocked, rn) THEN arg_max(start, rn) END AS unlock_at FROM awalk GROUP BY org_id", ALLOW)
def r17(d):
    return slices.allowance(d.ev.where("event_type = 'purchase'"), 5, 24, dt.datetime(2024, 1, 30, 12))


USE = {"tr": "SELECT org_id, event_id // 3 AS scan_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status, lag(CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'running' END) OVER (PARTITION BY org_id, event_id // 3 ORDER BY ts, event_id) AS old_status FROM ev"}


@query("g57_usage_ledger", """SELECT t.org_id, t.scan_id, min(ts) AS completed_at, CASE org_id % 3 WHEN 0 THEN 'payg' WHEN 1 THEN 'growth' ELSE 'free' END AS plan_code, CASE org_id % 3 WHEN 0 THEN 29 END AS amount_inr FROM tr t
    WHERE status = 'completed' AND coalesce(old_status, '') <> 'completed' AND scan_id % 10 <> 0 GROUP BY t.org_id, t.scan_id""", USE)
def g57(d):
    from pyspark.sql import Window
    scan = F.floor(F.col("event_id") / 3)
    st = F.when(F.col("event_type") == "purchase", "completed").otherwise("running")
    e = d.ev.select("org_id", scan.alias("scan_id"), "ts", "event_id", st.alias("status"))
    t = e.withColumn("old_status", F.lag("status").over(Window.partitionBy("org_id", "scan_id").orderBy("ts", "event_id")))
    plans = d.ev.select("org_id").distinct().where("org_id % 3 <> 2").select(
        "org_id", F.when(F.col("org_id") % 3 == 0, "payg").otherwise("growth").alias("plan_code"), F.lit(None).cast("int").alias("price_per_audit"))
    ledger = e.where("scan_id % 10 = 0").select("org_id", "scan_id").distinct()
    return LC.usage_ledger(t, plans, ledger)


@query("g55_usage_limits", """SELECT u.org_id, setups, stores, scans, p.setup_limit, p.setup_limit IS NULL OR setups < p.setup_limit AS can_add_setup, p.code IN ('enterprise', 'payg') OR p.scan_quota IS NULL OR scans < p.scan_quota AS can_start_scan FROM (
    SELECT org_id, count(DISTINCT CASE WHEN status <> 'F' THEN scan_id END) AS setups, count(DISTINCT store_id) AS stores, count(*) FILTER (status = 'F') AS scans FROM scans GROUP BY org_id) u
    LEFT JOIN (VALUES (0, 'free', 1, 5), (1, 'starter', 3, 300), (2, 'growth', 10, 3000), (3, 'payg', NULL, NULL), (4, 'enterprise', NULL, NULL)) p(k, code, setup_limit, scan_quota) ON u.org_id % 5 = p.k""")
def g55(d):
    # Plan limits by plan code; a null limit means unlimited.
    plans = F.when(F.col("k") == 0, F.struct(F.lit("free").alias("code"), F.lit(1).alias("setup_limit"), F.lit(5).alias("scan_quota"))).when(
        F.col("k") == 1, F.struct(F.lit("starter").alias("code"), F.lit(3).alias("setup_limit"), F.lit(300).alias("scan_quota"))).when(
        F.col("k") == 2, F.struct(F.lit("growth").alias("code"), F.lit(10).alias("setup_limit"), F.lit(3000).alias("scan_quota"))).otherwise(
        F.struct(F.when(F.col("k") == 3, "payg").otherwise("enterprise").alias("code"), F.lit(None).cast("int").alias("setup_limit"), F.lit(None).cast("int").alias("scan_quota")))
    u = d.scans.groupBy("org_id").agg(F.count_distinct(F.when(F.col("status") != "F", F.col("scan_id"))).alias("setups"), F.count_distinct("store_id").alias("stores"), F.count_if(F.col("status") == "F").alias("scans"))
    u = u.withColumn("k", F.col("org_id") % 5).withColumn("p", plans)
    lim, quota = F.col("p.setup_limit"), F.col("p.scan_quota")
    return u.select("org_id", "setups", "stores", "scans", lim.alias("setup_limit"), (lim.isNull() | (F.col("setups") < lim)).alias("can_add_setup"),
                    (F.col("p.code").isin("enterprise", "payg") | quota.isNull() | (F.col("scans") < quota)).alias("can_start_scan"))


@query("g56_feature_entitlement", """SELECT event_id, CASE WHEN event_type = 'signup' THEN true ELSE coalesce(CAST(json_extract_string(props, '$.k') AS INT) % 2 = 1, false) END AS enabled FROM ev""")
def g56(d):
    ents = F.from_json(F.concat(F.lit('{"api":'), F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 1, "true").otherwise("false"), F.lit("}")), "map<string,boolean>")
    return d.ev.select("event_id", F.when(F.col("event_type") == "signup", True).otherwise(F.coalesce(F.try_element_at(ents, F.lit("api")), F.lit(False))).alias("enabled"))


@query("f19_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_exists(props, '$.k') AS has_k FROM ev")
def f19(d):
    return d.ev.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.array_contains(F.json_object_keys("props"), "k").alias("has_k"))


@query("f20_json_arrays", "SELECT event_id, 2 AS n, v FROM ev, LATERAL (SELECT unnest([CAST(json_extract_string(props, '$.k') AS INT), CAST(org_id AS INT)]) AS v)")
def f20(d):
    arr = F.from_json(F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), F.col("org_id").cast("string"), F.lit("]")), "array<int>")
    return d.ev.select("event_id", F.size(arr).alias("n"), F.explode(arr).alias("v"))


@query("f27_hashes", "SELECT event_id, sha256(CAST(org_id AS VARCHAR) || ':' || event_type) AS h FROM ev")
def f27(d):
    return d.ev.select("event_id", F.sha2(F.concat_ws(":", F.col("org_id").cast("string"), "event_type"), 256).alias("h"))


@query("g60_rca_completeness", """SELECT assignment_id, count(*) FILTER (coalesce(actual_qty - expected_qty, 0) <> 0 AND nullif(trim(coalesce(rca_code, '')), '') IS NULL) AS missing_rca,
    count(*) FILTER (coalesce(actual_qty - expected_qty, 0) <> 0 AND nullif(trim(coalesce(rca_code, '')), '') IS NULL) = 0 AS ok FROM audit GROUP BY assignment_id""")
def g60(d):
    missing = F.count_if((F.coalesce(F.col("actual_qty") - F.col("expected_qty"), F.lit(0)) != 0) & F.nullif(F.trim(F.coalesce("rca_code", F.lit(""))), F.lit("")).isNull())
    return d.audit.groupBy("assignment_id").agg(missing.alias("missing_rca"), (missing == 0).alias("ok"))


@query("g61_operational_rates", f"""SELECT org_id, round_even(avg(epoch(due_at - created_at) / 3600.0e0) FILTER (status = 'completed'), 3) AS resolution_hours, round_even(count(*) FILTER (status <> 'completed' AND due_at < {NOW_SQL}) / nullif(count(*) FILTER (status <> 'completed'), 0), 4) AS overdue_rate,
    round_even(count(*) FILTER (again) / count(*), 4) AS recurrence_rate, round_even(count(DISTINCT assignee_id) / count(*), 4) AS dedup_ratio
    FROM (SELECT *, created_at - lag(created_at) OVER (PARTITION BY org_id, assignee_id ORDER BY created_at, assignment_id) <= to_days(14) AS again FROM asg) GROUP BY org_id""")
def g61(d):
    from pyspark.sql import Window
    prev = F.lag("created_at").over(Window.partitionBy("org_id", "assignee_id").orderBy("created_at", "assignment_id"))
    a = d.asg.withColumn("again", F.col("created_at") - prev <= S.days(F.lit(14)))
    done, open_ = F.col("status") == "completed", F.col("status") != "completed"
    secs = F.unix_timestamp(F.col("due_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return a.groupBy("org_id").agg(
        F.bround(F.avg(F.when(done, secs / 3600.0)), 3).alias("resolution_hours"),
        F.bround(F.count_if(open_ & (F.col("due_at") < now())) / F.nullif(F.count_if(open_), F.lit(0)), 4).alias("overdue_rate"),
        F.bround(F.count_if("again") / F.count("*"), 4).alias("recurrence_rate"), F.bround(F.count_distinct("assignee_id") / F.count("*"), 4).alias("dedup_ratio"))


@query("w3_latest_per_sku", "SELECT sku, qty, counted_at FROM (SELECT sku, expected_qty AS qty, counted_at, row_number() OVER (PARTITION BY sku ORDER BY counted_at DESC NULLS LAST, tie DESC) AS rn FROM (SELECT *, assignment_id * 10 + ln AS tie FROM audit)) WHERE rn = 1")
def w3(d):
    rows = d.audit.select("sku", F.col("expected_qty").alias("qty"), "counted_at", (F.col("assignment_id") * 10 + F.col("ln")).alias("tie"))
    return LC.latest_wins(rows, "sku", "counted_at", "tie").select("sku", "qty", "counted_at")


@query("r18_catalogue_refresh", """SELECT coalesce(n.sku, c.sku) AS sku, coalesce(n.brand, c.brand) AS brand, greatest(c.hit_count, n.hit_count) AS hit_count, coalesce(n.updated_at, c.updated_at) AS updated_at
    FROM (SELECT p_partkey AS sku, p_brand AS brand, CAST(p_size AS BIGINT) AS hit_count, TIMESTAMP '1995-01-01' AS updated_at FROM part WHERE p_size % 2 = 0) c
    FULL JOIN (SELECT l_partkey AS sku, any_value(upper(p_brand)) AS brand, count(*) AS hit_count, max(l_shipdate) AS updated_at FROM base WHERE l_partkey % 3 <> 0 GROUP BY l_partkey) n ON c.sku = n.sku""")
def r18(d):
    cur = d.table("part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("sku"), F.col("p_brand").alias("brand"), F.col("p_size").cast("bigint").alias("hit_count"), F.lit("1995-01-01").cast("timestamp_ntz").alias("updated_at"))
    inc = d.base.where("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").alias("sku")).agg(F.upper(F.first("p_brand")).alias("brand"), F.count("*").alias("hit_count"), F.max("l_shipdate").alias("updated_at"))
    return LC.refresh_catalogue(cur, inc)


@query("w10_count_trend", """SELECT store_id, sku, ts, seq, human, prev_human, ai_then, abs(human - ai_then) > 2 AS disagrees FROM (SELECT *, last_value(ai IGNORE NULLS) OVER w AS ai_then, last_value(human IGNORE NULLS) OVER (PARTITION BY store_id, sku ORDER BY ts, k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_human FROM (
    SELECT store_id % 5 AS store_id, sku, counted_at AS ts, assignment_id * 10 + ln AS seq, 1 AS k, expected_qty AS human, NULL AS ai FROM audit WHERE ln <= 4
    UNION ALL SELECT store_id % 5, sku, counted_at, assignment_id * 10 + ln, 0, NULL, actual_qty FROM audit WHERE ln > 4 AND actual_qty IS NOT NULL) WINDOW w AS (PARTITION BY store_id, sku ORDER BY ts, k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE k = 1""")
def w10(d):
    base = d.audit.select((F.col("store_id") % 5).alias("store_id"), "sku", F.col("counted_at").alias("ts"), (F.col("assignment_id") * 10 + F.col("ln")).alias("seq"), "ln", "expected_qty", "actual_qty")
    return LC.running_trend(base.where("ln <= 4").withColumn("qty", F.col("expected_qty")), base.where("ln > 4 AND actual_qty IS NOT NULL").withColumn("qty", F.col("actual_qty")), 2)


@query("j26_valid_versions", """SELECT s.scan_id, max(v.version_id) AS version_id FROM scans s JOIN (SELECT o_custkey % 50 AS store_id, o_orderkey AS version_id, o_orderdate AS valid_from, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + to_days(90) END AS valid_to FROM orders WHERE o_orderpriority = '1-URGENT') v
    ON s.store_id = v.store_id AND s.scan_ts >= v.valid_from AND (v.valid_to IS NULL OR s.scan_ts < v.valid_to) GROUP BY s.scan_id""")
def j26(d):
    """Newest version valid at capture time.

    A version is spread over the months it covers, open-ended ones over the months of the data, and
    joined on (store, month); only candidates of that month are compared.
    """
    v = d.table("orders").where("o_orderpriority = '1-URGENT'").select(
        (F.col("o_custkey") % 50).alias("store_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate") + S.days(F.lit(90))).alias("valid_to"))
    s = d.scans.select("scan_id", "store_id", "scan_ts")
    horizon = F.lit(s.agg(F.max("scan_ts")).first()[0]).cast("timestamp_ntz")
    month = lambda c: F.year(c) * 12 + F.month(c)
    spread = v.withColumn("m", F.explode(F.sequence(month("valid_from"), F.greatest(month("valid_from"), month(F.coalesce("valid_to", horizon))))))
    hit = s.withColumn("m", month("scan_ts")).join(spread, ["store_id", "m"]).where(
        (F.col("scan_ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("scan_ts") < F.col("valid_to"))))
    return hit.groupBy("scan_id").agg(F.max("version_id").alias("version_id"))


@query("q1_variance_consistency", "SELECT store_id, count(*) FILTER (stored IS DISTINCT FROM actual_qty - expected_qty) AS mismatches FROM (SELECT *, CASE WHEN sku % 50 = 0 THEN 1 ELSE actual_qty - expected_qty END AS stored FROM audit WHERE actual_qty IS NOT NULL) GROUP BY store_id")
def q1(d):
    stored = F.when(F.col("sku") % 50 == 0, 1).otherwise(F.col("actual_qty") - F.col("expected_qty"))
    return d.audit.where("actual_qty IS NOT NULL").groupBy("store_id").agg(F.count_if(~stored.eqNullSafe(F.col("actual_qty") - F.col("expected_qty"))).alias("mismatches"))


@query("q2_rarely_audited_parts", "SELECT p_partkey, count(l_orderkey) AS audits FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_returnflag = 'R' GROUP BY p_partkey HAVING count(l_orderkey) < 4")
def q2(d):
    li = d.table("lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return d.table("part").select("p_partkey").join(li, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("audits")).where("audits < 4")


@query("q3_counts_by_class", "SELECT status, priority, count(*) AS n FROM scans GROUP BY ALL")
def q3(d):
    return d.scans.groupBy("status", "priority").agg(F.count("*").alias("n"))


@query("q4_customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
def q4(d):
    o = d.table("orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return d.table("customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("q5_bad_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F')")
def q5(d):
    return d.table("orders").where("o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F')").select("o_orderkey")


@query("q6_plan_limit_check", "SELECT c_custkey, count(o_orderkey) AS used, CASE WHEN count(o_orderkey) <= 10 THEN 'OK' ELSE 'FAIL' END AS check_result FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q6(d):
    o = d.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    used = F.coalesce("n", F.lit(0))
    return d.table("customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", used.alias("used"), F.when(used <= 10, "OK").otherwise("FAIL").alias("check_result"))


@query("q7_sku_variance_events", "SELECT a.sku, count(*) AS adjustment_events FROM audit a JOIN scans s ON a.assignment_id = s.scan_id JOIN customer c ON s.store_id = c.c_custkey WHERE c.c_name ILIKE '%0000001%' AND a.actual_qty - a.expected_qty <> 0 GROUP BY a.sku")
def q7(d):
    c = d.table("customer").where(F.col("c_name").ilike("%0000001%")).select(F.col("c_custkey").alias("scan_store"))
    s = d.scans.select(F.col("scan_id").alias("assignment_id"), F.col("store_id").alias("scan_store")).join(c, "scan_store")
    return d.audit.where("actual_qty - expected_qty <> 0").join(s, "assignment_id").groupBy("sku").agg(F.count("*").alias("adjustment_events"))
