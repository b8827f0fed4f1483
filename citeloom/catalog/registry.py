"""Where queries and their SQL counterparts are kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.catalog.stand_ins import CTES, Tables
from citeloom.runtime import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *uses: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``uses`` are the CTEs ``sql`` reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(uses, sql)
        return fn

    return register


def with_ctes(uses, body: str) -> str:
    """Prefix ``body`` with the CTEs it needs, dependencies first."""
    ordered: list[str] = []

    def visit(cte: str) -> None:
        if cte in ordered:
            return
        for needed in CTES[cte][0]:
            visit(needed)
        ordered.append(cte)

    for cte in uses:
        visit(cte)
    body = body.strip()
    if not ordered:
        return body
    listed = ",\n".join(f"{cte} as (\n{CTES[cte][1].strip()}\n)" for cte in ordered)
    if body.lower().startswith("with recursive "):
        return f"with recursive {listed},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {listed},\n{body[len('with '):]}"
    return f"with {listed}\n{body}"
