"""Query registry: each entry pairs a Spark query with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwright.plans.domain import CTES, Domain

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def with_ctes(select: str, own: dict[str, str] | None = None) -> str:
    """Prefix a select with the shared table expressions it mentions, in dependency order."""
    defs = {**CTES, **(own or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if name in defs and name not in ordered and name not in visiting:
                visiting.append(name)
                visit(defs[name])
                ordered.append(name)

    visiting: list[str] = []
    visit(select)
    if not ordered:
        return select
    recursive = "RECURSIVE " if any("/*recursive*/" in defs[n] for n in ordered) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS {'MATERIALIZED ' if '/*stored*/' in defs[n] else ''}({defs[n]})" for n in ordered) + "\n" + select


def exact_round(sql: str) -> str:
    """Half-even rounding on the shortest decimal form of a double, as the engine rounds."""
    out, i, mark = [], 0, "round_even("
    while (j := sql.find(mark, i)) >= 0:
        k, depth, comma = j + len(mark), 1, -1
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        body, places = exact_round(sql[j + len(mark):comma]), sql[comma + 1:k - 1].strip()
        out.append(sql[i:j] + f"CAST(round_even(CAST(CAST(CAST({body} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,20)), {places}) AS DOUBLE)")
        i = k
    return "".join(out) + sql[i:]


def query(key: str, sql: str | None = None, own: dict[str, str] | None = None):
    """Register ``fn(domain) -> DataFrame`` under ``key`` with its SQL counterpart."""

    def wrap(fn: Callable[[Domain], DataFrame]):
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")
        _QUERIES[key] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if sql is not None:
            _SQL[key] = exact_round(with_ctes(sql, own))
        return fn

    return wrap


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
