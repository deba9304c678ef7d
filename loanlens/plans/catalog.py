"""Registry of named queries: each is a Spark plan over the benchmark tables
plus its DuckDB reference SQL (or none, for checks done in pytest)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

ROUND_DIGITS = 9


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: list = field(default_factory=list)


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    """Round double outputs so that two engines' last-bit differences (from a
    different summation order) do not change the result."""
    return df.selectExpr(*[f"round(`{c}`, {digits}) AS `{c}`" if t == "double" else f"`{c}`"
                           for c, t in df.dtypes])


def wrap_sql(sql: str, doubles) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, {ROUND_DIGITS}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def query(name: str, sql: str | None = None, doubles=()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir.rstrip("/")))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, wrap_sql(sql, doubles) if sql else None, list(doubles))
        return fn
    return deco
