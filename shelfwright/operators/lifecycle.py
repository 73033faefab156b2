"""Findings, schedules, reminders, hierarchy, expiry and usage as set-based jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions import schedule as S
from shelfwright.operators.slices import carried


def with_variance(lines: DataFrame) -> DataFrame:
    q, pct, val = S.variance(F.col("expected_qty"), F.col("actual_qty"), F.col("mrp_inr"))
    return lines.withColumns({"variance_qty": q, "variance_pct": pct, "variance_value_inr": val})


def variance_findings(lines: DataFrame, sla: DataFrame | None, known: DataFrame, now: Column) -> DataFrame:
    """New findings from non-zero counted variances, with severity and due time, once per line."""
    v = with_variance(lines).where(F.coalesce("variance_qty", F.lit(0)) != 0)
    a, e, q, val = F.col("actual_qty"), F.col("expected_qty"), F.abs("variance_qty"), F.abs(F.coalesce("variance_value_inr", F.lit(0.0)))
    oos = (a == 0) & (e > 0)
    kind = F.when(oos, "out_of_stock").when(F.col("variance_qty") < 0, "inventory_shortage").otherwise("inventory_excess")
    sev = F.when(oos | (val >= 10000), "critical").when(q >= 10, "high").when(q >= 3, "medium").otherwise("low")
    out = v.withColumns({"finding_type": kind, "severity": sev}).join(known, ["assignment_id", "pos"], "left_anti")
    if sla is not None:
        out = out.join(sla, ["org_id", "severity"], "left")
        due = S.sla_hours(F.col("severity"), F.col("sla_hours"))
    else:
        due = S.sla_hours(F.col("severity"))
    return out.withColumn("due_at", now + S.hours(due))


def line_findings(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Findings from comparison lines that are not correct; a line is reported once."""
    issue = F.col("issue_type")
    kind = (
        F.when(issue == "missing", "missing_product").when(issue.isin("wrong_product", "wrong_location"), "wrong_placement")
        .when(issue == "wrong_category", "planogram_violation")
        .when(issue == "qty_mismatch", F.when(F.coalesce("actual_qty", F.lit(0)) == 0, "out_of_stock").otherwise("planogram_violation"))
        .otherwise("shelf_execution_issue"))
    sev = F.when(F.coalesce("severity", F.lit("warning")) == "critical", "critical").when(
        F.coalesce("severity", F.lit("warning")) == "warning", "high").otherwise("medium")
    return lines.where(~F.coalesce(issue, F.lit("")).isin("correct", "ok")).join(known, ["scan_id", "pos"], "left_anti").select(
        "scan_id", "pos", kind.alias("finding_type"), sev.alias("severity"),
        (F.coalesce("actual_qty", F.lit(0)) - F.coalesce("expected_qty", F.lit(0))).alias("variance_units"))


def mark_overdue(actions: DataFrame, now: Column) -> DataFrame:
    late = F.col("due_at").isNotNull() & (F.col("due_at") < now) & F.col("status").isin("open", "assigned", "in_progress", "rejected")
    return actions.withColumn("status", F.when(late, "overdue").otherwise(F.col("status")))


def due_schedules(sched: DataFrame, occurrences: DataFrame, now: Column) -> DataFrame:
    """Schedules due now whose occurrence has not been created yet, with key and due time."""
    due = sched.where(F.col("active") & (F.col("next_run_at") <= now) & (
        F.col("max_occurrences").isNull() | (F.coalesce("occurrence_count", F.lit(0)) < F.col("max_occurrences"))))
    keyed = due.withColumn("occurrence_key", S.occurrence_key(F.col("next_run_at"), F.col("tz")))
    offset = F.coalesce(F.get_json_object("due_config", "$.dueOffsetHours").cast("int"), F.lit(24))
    return keyed.join(occurrences, ["schedule_id", "occurrence_key"], "left_anti").withColumn(
        "due_at", F.col("next_run_at") + S.hours(offset))


def schedule_assignments(due: DataFrame) -> DataFrame:
    """One assignment per store, assignees dealt out round-robin by store position."""
    stores = due.select("*", F.posexplode("store_ids").alias("i", "target_store"))
    pick = F.element_at("assignee_ids", (F.col("i") % F.size("assignee_ids") + 1).cast("int"))
    return stores.select("schedule_id", "occurrence_key", F.col("target_store").alias("store_id"), pick.alias("assignee_id"), "due_at")


def advance_schedules(due: DataFrame, now: Column) -> DataFrame:
    once = F.col("assignment_mode") == "schedule_once"
    full = F.col("max_occurrences").isNotNull() & (F.coalesce("occurrence_count", F.lit(0)) + 1 >= F.col("max_occurrences"))
    nxt = S.next_run(F.col("cadence"), F.col("day_of_week"), F.col("day_of_month"), now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1)))
    return due.select(
        "schedule_id", (F.coalesce("occurrence_count", F.lit(0)) + 1).alias("occurrence_count"),
        F.when(~once, nxt).alias("next_run_at"), F.when(once | full, "completed").otherwise("active").alias("status"))


def reminders(assignments: DataFrame, settings: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """Due-soon, overdue and escalation notices, each at most once (null-safe against the log)."""
    rows = assignments.where(F.col("status").isin("pending", "in_progress") & (F.col("due_at") > now - S.days(F.lit(7)))).join(
        settings, "org_id", "left")
    late = F.col("due_at") < now
    none = F.lit(None).cast("int")
    overdue = rows.where(late).select("assignment_id", F.lit("overdue").alias("reminder_type"), none.alias("hours"), F.col("assignee_id").alias("user_id"))
    escal = rows.where(late & F.col("escalation_user_id").isNotNull()).select(
        "assignment_id", F.lit("escalation").alias("reminder_type"), none.alias("hours"), F.col("escalation_user_id").alias("user_id"))
    buckets = F.coalesce("reminder_hours", F.array(*[F.lit(h) for h in (24, 12, 4, 1)]))
    soon = rows.where(~late).select("*", F.explode(buckets).alias("h")).where(
        (F.col("due_at") <= now + S.hours(F.col("h"))) & (F.col("due_at") > now + S.hours(F.col("h") - 1))).select(
        "assignment_id", F.lit("due_soon").alias("reminder_type"), F.col("h").alias("hours"), F.col("assignee_id").alias("user_id"))
    new = overdue.unionByName(escal).unionByName(soon)
    log = sent.select(F.col("assignment_id").alias("a"), F.col("reminder_type").alias("t"), F.col("hours").alias("h"))
    return new.join(log, (F.col("assignment_id") == F.col("a")) & (F.col("reminder_type") == F.col("t")) & F.col("hours").eqNullSafe(F.col("h")), "left_anti")


def members_by_role(members: DataFrame, notices: DataFrame) -> DataFrame:
    """Active members whose role is among the roles of a notice of their organisation."""
    m = members.where((F.col("status") == "active") & F.col("user_id").isNotNull())
    return notices.join(m, "org_id").where(F.array_contains("roles", F.lower("role"))).select("notice_id", "org_id", "user_id")


def expiry_counts(packets: DataFrame) -> DataFrame:
    """Packets per class of each attempt after the latest record per ordinal."""
    cnt = lambda *c: F.count_if(F.col("classification").isin(*c))
    return packets.groupBy("attempt_id").agg(
        cnt("sellable").alias("sellable"), cnt("expired", "near_expiry").alias("remove"), cnt("unresolved").alias("unresolved"),
        cnt("expired").alias("expired"), F.count("*").alias("observations"))


def replay_observations(packets: DataFrame) -> DataFrame:
    """Latest record per attempt and ordinal; rule violations are rejected before they count."""
    ok = packets.where(~(F.col("unreadable") & (F.col("classification") == "sellable")))
    rec = F.struct("classification", "unreadable", "store_id", "file_hash")
    return ok.groupBy("attempt_id", "packet_ordinal").agg(F.max_by(rec, F.struct("ts", "pos")).alias("r")).select(
        "attempt_id", "packet_ordinal", "r.*")


def reconciliation(attempts: DataFrame, counts: DataFrame) -> DataFrame:
    """physical = sellable + remove + unresolved and observations = physical."""
    j = attempts.join(counts, "attempt_id", "left")
    p = F.col("physical_count")
    ok = (p == F.col("sellable") + F.col("remove") + F.col("unresolved")) & (F.col("observations") == p)
    return j.select("attempt_id", "physical_count", F.coalesce(ok, F.lit(False)).alias("reconciled"))


def expiry_exceptions(attempts: DataFrame, counts: DataFrame, open_now: DataFrame) -> DataFrame:
    """Exceptions to raise per attempt, unless the same one is already open."""
    j = attempts.join(counts, "attempt_id", "left")
    item = lambda n, sev, prio, q: F.struct(F.lit(n).alias("issue_type"), F.lit(sev).alias("severity"), F.lit(prio).alias("sort_priority"), q.cast("bigint").alias("quantity"))
    gap = F.abs(F.col("actual_quantity") - F.col("expected_quantity"))
    cand = F.array(
        F.when((F.col("expired") > 0) & F.col("removal_status").isin("not_required", "required"), item("expired_not_quarantined", "critical", 1, F.col("expired"))),
        F.when(F.col("unresolved") > 0, item("unresolved_not_held", "high", 2, F.col("unresolved"))),
        F.when(F.col("actual_quantity").isNotNull() & (gap != 0), item("quantity_mismatch", "high", 4, gap)))
    return j.select("attempt_id", F.explode(F.array_compact(cand)).alias("x")).select("attempt_id", "x.*").join(
        open_now, ["attempt_id", "issue_type"], "left_anti")


def expiry_overview(attempts: DataFrame, packets: DataFrame, now: Column) -> DataFrame:
    """Counters per organisation and per organisation and store, in one pass over grouping sets."""
    a = attempts.select("org_id", "store_id", "expected_quantity", "inspection_status", "removal_status", "due_at", F.lit(None).cast("string").alias("c"), F.lit(None).cast("boolean").alias("u"))
    p = packets.join(attempts.select("attempt_id", "org_id", F.col("store_id").alias("st")), "attempt_id").select(
        "org_id", F.col("st").alias("store_id"), F.lit(None).cast("bigint").alias("expected_quantity"), F.lit(None).cast("string").alias("inspection_status"),
        F.lit(None).cast("string").alias("removal_status"), F.lit(None).cast("timestamp_ntz").alias("due_at"), F.col("classification").alias("c"), F.col("unreadable").alias("u"))
    both = a.unionByName(p)
    return both.groupingSets([["org_id"], ["org_id", "store_id"]], "org_id", "store_id").agg(
        F.sum(F.when(F.col("inspection_status").isin("assigned", "in_progress", "submitted", "under_review"), F.col("expected_quantity")).otherwise(0)).alias("units_in_scope"),
        F.count_if(F.col("c") == "expired").alias("expired_detected"), F.count_if(F.col("c") == "near_expiry").alias("near_expiry"),
        F.count_if((F.col("c") == "unresolved") | F.col("u")).alias("unresolved_dates"),
        F.count_if(F.col("removal_status") == "reported_removed").alias("awaiting_removal"),
        F.count_if(F.col("removal_status") == "received_quarantine").alias("in_quarantine"),
        F.count_if((F.col("due_at") < now) & F.col("inspection_status").isin("assigned", "in_progress")).alias("overdue_inspections"))


def usage_ledger(transitions: DataFrame, plans: DataFrame, ledger: DataFrame) -> DataFrame:
    """One billable row per scan that turned completed, not yet in the ledger."""
    new = transitions.where("status = 'completed'").where(F.coalesce("old_status", F.lit("")) != "completed").groupBy("org_id", "scan_id").agg(
        F.min("ts").alias("completed_at"))
    j = new.join(ledger, ["org_id", "scan_id"], "left_anti").join(plans, "org_id", "left")
    return j.select("org_id", "scan_id", "completed_at", F.coalesce("plan_code", F.lit("free")).alias("plan_code"),
                    F.when(F.col("plan_code") == "payg", F.coalesce("price_per_audit", F.lit(29))).alias("amount_inr"))


def latest_wins(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Newest row per key, nulls last; aggregated before the shuffle."""
    cols = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*cols), F.struct(F.col(ts).isNotNull(), F.col(ts), F.col(tie)))
    return rows.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


def refresh_catalogue(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by SKU: incoming attributes win, the larger hit count stays."""
    j = current.alias("c").join(incoming.alias("n"), "sku", "full")
    return j.select("sku", F.coalesce("n.brand", "c.brand").alias("brand"), F.greatest("c.hit_count", "n.hit_count").alias("hit_count"),
                    F.coalesce("n.updated_at", "c.updated_at").alias("updated_at"))


def running_trend(counts: DataFrame, readings: DataFrame, threshold: int, seconds: int = 86_400) -> DataFrame:
    """Human count against the last machine reading and the previous human count of a store and SKU, however long ago."""
    both = counts.select("store_id", "sku", "ts", "seq", F.lit(1).alias("k"), F.col("qty").alias("human"), F.lit(None).cast("int").alias("ai")).unionByName(
        readings.select("store_id", "sku", "ts", "seq", F.lit(0).alias("k"), F.lit(None).cast("int").alias("human"), F.col("qty").alias("ai")))
    out = carried(both, ["store_id", "sku"], ["ts", "k", "seq"], {"ai_then": ("ai", True), "prev_human": ("human", False)}, seconds).where("k = 1")
    return out.select("store_id", "sku", "ts", "seq", "human", "prev_human", "ai_then",
                      (F.abs(F.col("human") - F.col("ai_then")) > threshold).alias("disagrees"))


def locked_edits(versions: DataFrame) -> DataFrame:
    """Versions that changed a value of a locked record without being a manager's edit."""
    w = Window.partitionBy("record_id").orderBy("version")
    prev = lambda c: F.lag(c).over(w)
    v = versions.select("*", prev("version").alias("pv"), prev("actual_qty").alias("pq"), prev("rca_code").alias("pr"))
    changed = ~F.col("actual_qty").eqNullSafe(F.col("pq")) | ~F.col("rca_code").eqNullSafe(F.col("pr"))
    return v.where(F.col("pv").isNotNull() & F.col("status").isin("submitted", "pending_review", "approved")
                   & ~F.coalesce("source", F.lit("")).eqNullSafe(F.lit("manager_edit")) & changed).select("record_id", "version")


def publish_versions(events: DataFrame) -> DataFrame:
    """Version number and snapshot of every publish event of a template."""
    w = Window.partitionBy("template_id").orderBy("ts", "event_id")
    return events.select("template_id", "event_id", F.row_number().over(w).alias("version"), F.to_json(F.struct("template_id", "name")).alias("snapshot"))
