"""Named queries: a DataFrame plan, its output columns and, where SQL can state it, a check.

Column specs read ``name:type`` with ``i`` integer, ``s`` text, ``b`` truth value (0/1) and
``fN`` a double kept to N places. Both sides are projected through the same spec.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.numbers import decimal_round
from headway.sources.mapping import CTES, TransitTables

Plan = Callable[[TransitTables], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    columns: list[tuple[str, str]]
    sql: str | None = None

    def dataframe(self, spark: SparkSession, folder: str) -> DataFrame:
        out = self.plan(TransitTables(spark, folder))
        return out.select(*[_spark_column(n, t) for n, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_ctes(self.sql)
        return f"SELECT {', '.join(_sql_column(n, t) for n, t in self.columns)} FROM ({body}) AS result"


REGISTRY: dict[str, Query] = {}


def register(name: str, columns: str, plan: Plan, sql: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} is already registered")
    REGISTRY[name] = Query(plan, [tuple(c.split(":")) for c in columns.split()], sql)


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        return c.cast("long").alias(name)
    if kind == "b":
        return c.cast("int").cast("long").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    return decimal_round(c.cast("double"), int(kind[1:])).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "b":
        return f'CAST(CAST("{name}" AS BOOLEAN) AS BIGINT) AS "{name}"'
    if kind == "s":
        return f'CAST("{name}" AS VARCHAR) AS "{name}"'
    return f'{rounded(f"""CAST("{name}" AS DOUBLE)""", int(kind[1:]))} AS "{name}"'


def rounded(x: str, places: int) -> str:
    """SQL for decimal rounding, half away from zero, that does not depend on the engine."""
    scale = 10**places
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5000001) / {scale} + 0.0)"


def rounded_even(x: str, places: int) -> str:
    """SQL for rounding with exact halves to the even neighbour."""
    s = f"(({x}) * {10**places})"
    return (
        f"(CASE WHEN abs({s} - floor({s}) - 0.5) < 1e-9 THEN 2 * floor({s} / 2 + 0.5)"
        f" ELSE floor({s} + 0.5) END / {10**places})"
    )


_LOCAL: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    """Add a named subquery that checks may refer to."""
    if name in _LOCAL or name in CTES:
        raise ValueError(f"subquery {name} is already defined")
    _LOCAL[name] = sql


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with exactly the named subqueries that it reaches."""
    known = {**CTES, **_LOCAL}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?i)\b(?:from|join)\s+(\w+)", text)):
            if word in known and word not in ordered:
                visit(known[word])
                if word not in ordered:
                    ordered.append(word)

    visit(sql)
    if not ordered:
        return sql
    head = ",\n".join(f"{name} AS ({known[name]})" for name in ordered)
    lead = sql.lstrip()
    if lead[:5].upper() == "WITH ":
        return f"WITH {head},\n{lead[5:]}"
    return f"WITH {head}\n{lead}"
