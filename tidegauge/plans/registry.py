"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidegauge.functions.scalar import rounded
from tidegauge.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
SHARED_SQL: dict[str, str] = {}


def shared(**ctes: str) -> None:
    """Register named sub-selects the check SQL may use."""
    SHARED_SQL.update(ctes)


def query(covers: str, sql: str | None = None):
    """Register a builder under its function name."""

    def add(fn):
        QUERIES[fn.__name__] = Query(fn.__name__, covers, fn, sql)
        return fn

    return add


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(QUERIES[name].build(Tables(spark, sf_dir)))


def check_sql(name: str) -> str | None:
    """The query's SQL with every shared sub-select it names put in front."""
    body = QUERIES[name].sql
    if body is None:
        return None
    order: list[str] = []

    def visit(text: str) -> None:
        for cte in SHARED_SQL:
            if cte not in order and re.search(rf"\b{cte}\b", text):
                visit(SHARED_SQL[cte])
                if cte not in order:
                    order.append(cte)

    visit(body)
    body = body.strip()
    if not order:
        return body
    head = ",\n".join(f"{c} AS ({SHARED_SQL[c].strip()})" for c in order)
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"
