"""Timers near the end of the table: due behind the last watermark, with a later event known, or in its last millisecond."""

from __future__ import annotations

import datetime as dt

import duckdb

import __spark_entry__ as entry


def test_timers_behind_the_last_watermark(spark, tmp_path):
    end = dt.datetime(2024, 1, 9, 12, 0, 0, 500_900)
    mark = end - dt.timedelta(minutes=10)  # the stream's watermark is .500, the SQL's .500900
    day, tick = dt.timedelta(hours=24), dt.timedelta(microseconds=1)
    rows = [
        (1, mark - day + dt.timedelta(minutes=2), 1, "signup"), (2, mark + dt.timedelta(minutes=5), 1, "purchase"),  # due before the known purchase
        (3, mark - day + dt.timedelta(minutes=5), 2, "signup"), (4, mark + dt.timedelta(minutes=2), 2, "purchase"),  # bought in time
        (5, mark - day - 500 * tick, 3, "signup"), (6, mark - day, 4, "signup"), (7, mark - day + tick, 5, "signup"),
        (8, mark - day - dt.timedelta(minutes=1), 6, "signup"), (9, mark - day + dt.timedelta(minutes=3), 7, "signup"), (10, end, 8, "purchase"),
    ]
    df = spark.createDataFrame([(i, t, u, k, 1.0, "{}") for i, t, u, k in rows], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.org_id, r.due) for r in entry.queries()["s6_overdue_timers"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["s6_overdue_timers"]).fetchall())
    assert [o for o, _ in want] == [1, 3, 6] and got == want
