"""Queries by name, each with SQL that says the same where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setlight.sources.standins import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_standins(sql: str) -> str:
    """Put the definitions of the stand-in tables that ``sql`` mentions in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(SQL[name])
                needed.append(name)

    need(sql)
    head = ", ".join(f"{name} as ({SQL[name]})" for name in needed)
    body = sql.strip()
    if not head:
        return body
    if m := re.match(r"with (recursive )?", body, re.I):
        return f"with {m[1] or ''}{head}, {body[m.end():]}"
    return f"with {head} {body}"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as query ``name``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_standins(sql)
        return fn

    return register
