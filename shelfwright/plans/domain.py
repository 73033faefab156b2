"""Shelf-audit tables derived from the star-schema test tables, in Spark and in SQL.

Every table is a plain projection of the given parquet tables, so the work of each query grows
with them. ``pos`` is the total order of rows inside a scan that the reading order of a payload
would give; real deployments carry it as a column.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shelfwright.session import cut_lineage

_POS = "l_linenumber * 10000000000000000 + l_partkey * 100000000 + l_suppkey * 100 + CAST(l_quantity AS INT)"
_CATEGORY = (
    "CASE p_size % 5 WHEN 0 THEN 'Snacks' WHEN 1 THEN 'Beverages' WHEN 2 THEN 'Personal Care' "
    "WHEN 3 THEN 'Dairy' ELSE 'General' END"
)
_SUB = "concat('sub_', CAST(p_size % 11 AS STRING))"

# Table expressions in the SQL subset that Spark and the checking database share.
SHARED = {
    "base": f"""SELECT l_orderkey AS scan_id, {_POS} AS pos, l_linenumber AS ln, l_partkey, l_suppkey,
        CAST(l_quantity AS INT) AS qty, l_discount, l_tax, l_extendedprice, l_returnflag, l_linestatus,
        l_shipdate, p_name, p_brand, p_type, p_size, p_retailprice,
        {_CATEGORY} AS category, {_SUB} AS sub_category
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "scans": """SELECT o_orderkey AS scan_id, o_custkey % 50 AS store_id, o_custkey % 7 AS org_id,
        o_orderdate AS scan_ts, o_orderstatus AS status, o_orderpriority AS priority,
        o_totalprice AS amount FROM orders""",
    # What the camera counted: one row per product line and location of a scan.
    "cv": """SELECT scan_id, pos, ln,
        CASE WHEN ln = 7 THEN 'Unknown' ELSE p_brand END AS brand,
        CASE WHEN ln = 5 THEN 'UNVERIFIABLE' ELSE p_name END AS product_name,
        CASE WHEN ln = 3 THEN 'UNVERIFIABLE' ELSE p_type END AS variant,
        CASE WHEN ln % 2 = 0 THEN concat('SKU-', CAST(l_partkey AS STRING)) ELSE '' END AS sku,
        CASE WHEN ln = 7 THEN 'UNVERIFIABLE' ELSE 'IDENTIFIED' END AS brand_status,
        CASE WHEN ln = 5 THEN 'UNVERIFIABLE' ELSE 'IDENTIFIED' END AS product_status,
        CASE WHEN ln = 3 THEN 'UNVERIFIABLE' ELSE 'IDENTIFIED' END AS variant_status,
        category, sub_category,
        CASE WHEN qty % 17 = 0 THEN NULL ELSE qty END AS actual_facings,
        CASE WHEN qty % 17 = 0 THEN NULL ELSE qty + ln % 3 - 1 END AS actual_visible_units,
        CASE WHEN l_suppkey % 5 = 0 THEN NULL
             WHEN l_suppkey % 5 = 1 THEN concat('a - ', CAST(l_suppkey % 3 AS STRING), '?')
             ELSE concat('A-', CAST(l_suppkey % 3 AS STRING), CAST(l_suppkey % 4 AS STRING)) END AS location_label,
        CASE WHEN ln % 2 = 0 THEN concat('R', CAST(l_suppkey % 4 AS STRING)) END AS rack_marker,
        CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN 'not visible'
             WHEN l_partkey % 4 = 2 THEN concat('Rs ', CAST(CAST(floor(p_retailprice) AS INT) AS STRING), '.00')
             ELSE CAST(CAST(floor(p_retailprice) AS INT) + ln - 4 AS STRING) END AS visible_price,
        CASE WHEN qty % 6 = 0 THEN 'Buy 2 get 1' END AS promotion_text,
        1 - l_discount AS confidence, p_retailprice
        FROM base WHERE ln >= 2""",
    # What the plan expects on the shelf of a scan.
    "plan": """SELECT scan_id, pos, ln, concat('A-', CAST(l_suppkey % 3 AS STRING), CAST(l_suppkey % 4 AS STRING)) AS location,
        category, sub_category, p_brand AS brand, p_name AS product_name,
        CASE WHEN ln = 3 THEN concat(p_type, ' gold edition') ELSE p_type END AS variant,
        CASE WHEN ln % 4 = 0 THEN concat('SKU-', CAST(l_partkey AS STRING)) ELSE '' END AS sku,
        1 + p_size % 10 AS expected_facings, p_size % 7 AS expected_qty,
        CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 10 END AS min_facings,
        CASE WHEN p_size % 4 = 0 THEN NULL ELSE 3 + p_size % 10 END AS max_facings,
        CASE WHEN p_size % 6 = 0 THEN NULL ELSE 2 + p_size % 10 END AS expected_shelf_units,
        CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS mrp_inr,
        CASE WHEN p_size % 8 = 0 THEN NULL ELSE p_size / 10.0e0 END AS avg_daily_sales,
        CASE WHEN ln % 3 = 0 THEN '' ELSE concat('S', CAST(ln % 3 AS STRING), '-P', CAST(l_suppkey % 20 AS STRING)) END AS shelf_position
        FROM base WHERE ln <= 6""",
    # SKU roll-up of the counted rows of a scan.
    "inv": """SELECT scan_id, min(pos) AS pos, CASE WHEN ln = 7 THEN 'Unknown' ELSE p_brand END AS brand,
        p_name AS product_name, p_type AS variant, min(category) AS category,
        CASE WHEN sum(qty) % 5 = 0 THEN 0 ELSE CAST(sum(qty) AS INT) END AS quantity,
        CAST(sum(qty) AS INT) AS facings, avg(1 - l_discount) AS confidence,
        max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) = 1 AS counted_in_totals,
        CASE WHEN min(p_size) % 6 = 0 THEN 'category_mismatch' ELSE 'ok' END AS compliance_status
        FROM base GROUP BY scan_id, CASE WHEN ln = 7 THEN 'Unknown' ELSE p_brand END, p_name, p_type""",
    # Planned rows with what the camera attached to them.
    "prows": """SELECT p.*, c.actual_facings, c.actual_visible_units, c.brand AS actual_brand,
        c.product_name AS actual_product, c.variant AS actual_variant, c.location_label, c.visible_price,
        c.pos IS NOT NULL AS attached, CASE WHEN c.pos IS NULL THEN 'NOT_FOUND' WHEN p.ln = 5 THEN 'BRAND_MATCHED'
        WHEN c.actual_facings IS NULL THEN 'UNVERIFIABLE' ELSE 'MATCHED' END AS match_status
        FROM plan p LEFT JOIN cv c ON p.scan_id = c.scan_id AND p.pos = c.pos""",
    # Comparison lines of a scan.
    "lines": """SELECT scan_id, pos, ln, CASE WHEN NOT attached THEN 'missing' WHEN actual_facings IS NULL THEN NULL
        WHEN ln = 4 THEN 'wrong_location' WHEN ln = 6 AND category = 'Dairy' THEN 'wrong_product'
        WHEN actual_facings <> expected_facings THEN 'qty_mismatch' ELSE 'correct' END AS issue_type,
        brand AS expected_brand, product_name AS expected_product, expected_facings AS expected_qty,
        coalesce(actual_facings, 0) AS actual_qty FROM prows WHERE pos % 10 <> 3
        UNION ALL SELECT scan_id, pos, ln, 'unexpected', brand, product_name, CAST(NULL AS INT), coalesce(actual_facings, 0)
        FROM cv WHERE ln = 7""",
    # One detected front pack with integer pixel boxes; eight orders make up one shelf photo.
    "fac": """SELECT scan_id // 8 AS scan_id, pos * 8 + scan_id % 8 AS pos, ln,
        CASE WHEN ln = 7 THEN 'Unknown' ELSE p_brand END AS brand, p_name AS product_name, p_type AS variant,
        CASE WHEN ln % 2 = 0 THEN concat('SKU-', CAST(l_partkey AS STRING)) ELSE '' END AS sku,
        category, sub_category, 1 - l_discount AS confidence,
        CAST((l_partkey * 37 + ln * 101 + l_suppkey * 7) % 1000 AS INT) AS x1,
        CAST(((l_suppkey * 53 + ln * 17) % 3) * 280 + l_partkey % 40 AS INT) AS y1,
        CAST((l_partkey * 37 + ln * 101 + l_suppkey * 7) % 1000 + 60 + l_partkey % 90 AS INT) AS x2,
        CAST(((l_suppkey * 53 + ln * 17) % 3) * 280 + l_partkey % 40 + 120 + l_suppkey % 100 AS INT) AS y2,
        CASE WHEN qty % 4 = 0 THEN '' WHEN qty % 4 = 1 THEN p_name
             ELSE concat(p_brand, ' ', p_name, ' MRP ', CAST(CAST(floor(p_retailprice) AS INT) AS STRING)) END AS pack_text,
        CASE WHEN qty % 4 = 0 THEN 0.0e0 ELSE l_tax * 10 END AS ocr_confidence,
        CASE WHEN qty % 5 = 0 THEN 'catalog' WHEN qty % 5 = 1 THEN 'ocr' WHEN qty % 5 = 2 THEN 'model' ELSE 'vector' END AS recognition_source,
        l_returnflag = 'R' AND ln = 6 AS exclude_from_inventory
        FROM base""",
    # One audit-trail row per event; the user stands for the organisation.
    "ev": """SELECT event_id, ts, user_id AS org_id, event_type, value, props FROM events""",
    # Recurring audit schedules; one order stands for one schedule.
    "sched": """SELECT o_orderkey AS schedule_id, o_custkey % 7 AS org_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'daily' WHEN '2-HIGH' THEN 'weekly' WHEN '3-MEDIUM' THEN 'monthly' ELSE 'custom' END AS cadence,
        CAST(o_orderkey % 7 AS INT) AS day_of_week, CAST(o_orderkey % 31 + 1 AS INT) AS day_of_month,
        o_orderdate + make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT)) AS next_run_at, o_orderstatus <> 'F' AS active,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Asia/Kolkata' WHEN o_orderkey % 3 = 1 THEN 'UTC' END AS tz,
        CASE WHEN o_orderkey % 5 = 0 THEN 3 END AS max_occurrences, CAST(o_orderkey % 4 AS INT) AS occurrence_count,
        CASE WHEN o_orderkey % 9 = 0 THEN 'schedule_once' ELSE 'recurring' END AS assignment_mode,
        CASE WHEN o_orderkey % 6 = 0 THEN concat(chr(123), '"dueOffsetHours": 36', chr(125)) ELSE concat(chr(123), chr(125)) END AS due_config,
        o_custkey AS store_id, o_custkey % 11 AS assignee_id FROM orders""",
    # Assignments with a due time by priority.
    "asg": """SELECT o_orderkey AS assignment_id, o_custkey % 7 AS org_id, o_custkey AS assignee_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS status,
        o_orderdate + make_interval(0, 0, 0, 0, CAST(o_orderkey % 97 AS INT)) AS due_at, o_orderdate AS created_at FROM orders""",
    # Packets checked during an expiry inspection; the order is the attempt.
    "pkt": """SELECT scan_id AS attempt_id, pos, ln AS packet_ordinal, l_suppkey % 50 AS store_id, l_shipdate AS ts, l_partkey AS sku,
        CASE l_returnflag WHEN 'A' THEN 'sellable' WHEN 'R' THEN 'expired' ELSE CASE WHEN qty % 3 = 0 THEN 'near_expiry' WHEN qty % 3 = 1 THEN 'unresolved' ELSE 'sellable' END END AS classification,
        qty % 7 = 0 AS unreadable, concat('h', CAST(l_partkey % 97 AS STRING)) AS file_hash FROM base""",
    # Human count of a line of an assignment.
    "audit": """SELECT scan_id AS assignment_id, pos, ln, l_partkey AS sku, l_suppkey % 50 AS store_id,
        1 + p_size % 10 AS expected_qty, CASE WHEN qty % 3 = 0 THEN 1 + p_size % 10 WHEN qty % 13 = 0 THEN NULL ELSE qty END AS actual_qty,
        p_retailprice AS mrp_inr,
        CASE WHEN l_returnflag = 'A' THEN 'THEFT' WHEN l_returnflag = 'N' THEN ' ' END AS rca_code,
        l_shipdate AS counted_at
        FROM base""",
}


def _duck(text: str) -> str:
    text = re.sub(r"make_interval\(0, 0, 0, 0, (CAST\(.*? AS INT\))\)", r"to_hours(\1)", text)
    return text.replace(" AS STRING", " AS VARCHAR")


def _spark(text: str) -> str:
    return text.replace("scan_id // 8", "scan_id DIV 8")


CTES = {name: _duck(body) for name, body in SHARED.items()}


class Domain:
    """Lazy access to the given tables and to the derived shelf-audit tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table stored in fewer splits than the cluster has cores is dealt out once."""
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def written(self) -> Domain:
        """The same tables for queries that read them many times: base, inventory and lines are made and written once."""
        d = Domain(self.spark, self.sf_dir)
        d.base = cut_lineage(self.base)
        d.inv = cut_lineage(d.inv)
        d.lines = cut_lineage(d.lines)
        return d

    def by_scan(self) -> Domain:
        """The same tables, from base rows that are dealt by scan once; what is grouped or joined within a scan needs no other shuffle."""
        d = Domain(self.spark, self.sf_dir)
        d.base = self.base.repartition("scan_id")
        return d

    def _derived(self, name: str, **sources: DataFrame) -> DataFrame:
        return self.spark.sql(_bind(_spark(SHARED[name]), sources), **sources)

    @cached_property
    def base(self) -> DataFrame:
        return self._derived("base", lineitem=self.spread("lineitem"), part=self.table("part"))

    @cached_property
    def scans(self) -> DataFrame:
        return self._derived("scans", orders=self.table("orders"))

    @cached_property
    def cv(self) -> DataFrame:
        return self._derived("cv", base=self.base)

    @cached_property
    def plan(self) -> DataFrame:
        return self._derived("plan", base=self.base)

    @cached_property
    def inv(self) -> DataFrame:
        return self._derived("inv", base=self.base)

    @cached_property
    def prows(self) -> DataFrame:
        return self._derived("prows", plan=self.plan, cv=self.cv)

    @cached_property
    def lines(self) -> DataFrame:
        return self._derived("lines", prows=self.prows, cv=self.cv)

    @cached_property
    def fac(self) -> DataFrame:
        return self._derived("fac", base=self.base)

    @cached_property
    def ev(self) -> DataFrame:
        return self._derived("ev", events=self.table("events"))

    @cached_property
    def sched(self) -> DataFrame:
        return self._derived("sched", orders=self.table("orders"))

    @cached_property
    def asg(self) -> DataFrame:
        return self._derived("asg", orders=self.table("orders"))

    @cached_property
    def pkt(self) -> DataFrame:
        return self._derived("pkt", base=self.base)

    @cached_property
    def audit(self) -> DataFrame:
        return self._derived("audit", base=self.base)


def _bind(text: str, sources: dict[str, DataFrame]) -> str:
    for name in sources:
        for lead in ("FROM ", "JOIN "):
            text = text.replace(f"{lead}{name}", lead + "{" + name + "}")
    return text
