"""Query registry: name -> (spark builder, oracle SQL or None), plus the DuckDB
stage texts that oracle queries compose as CTEs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_DEPS, duck_view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB stage name -> (sql, dependencies)
STAGES: dict[str, tuple[str, tuple[str, ...]]] = {}


def stage(name: str, sql: str, *deps: str) -> None:
    STAGES[name] = (sql, deps)


def _deps_of(name: str) -> tuple[str, ...]:
    if name in STAGES:
        return STAGES[name][1]
    if name in VIEW_DEPS:
        return ()
    raise KeyError(f"unknown oracle stage {name}")


def _sql_of(name: str) -> str:
    if name in STAGES:
        return STAGES[name][0]
    return duck_view_sql(name)


def oracle(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with every needed view/stage as a CTE, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _deps_of(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{_sql_of(n).strip()}\n)" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{sql}"


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def round_sql(inner: str, doubles: list[str], digits: int = 6) -> str:
    """Wrap an oracle query so the listed double columns are rounded like the Spark side."""
    if not doubles:
        return inner
    rep = ", ".join(f"floor({c} * 1e{digits} + 5e-1) / 1e{digits} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) AS _r"
