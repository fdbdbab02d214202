"""Named queries over a test folder, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    """Register ``fn(spark, sf_dir)``; ``headline`` queries are the timed ones."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return wrap


def sql_case(subject: str, mapping: dict, otherwise: str) -> str:
    """A SQL CASE over a fixed dictionary of strings."""
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {subject} {arms} ELSE {otherwise} END"


def sql_ladder(subject: str, steps, otherwise: str) -> str:
    arms = " ".join(f"WHEN {subject} >= {b} THEN {v!r}" for b, v in steps)
    return f"CASE {arms} ELSE {otherwise} END"


def sql_values(rows) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else ("NULL" if v is None else repr(v))
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
