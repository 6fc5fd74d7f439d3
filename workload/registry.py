"""Registering a query together with the SQL that checks it.

A query states its result columns once, as ``name:kind``. Both sides render them alike: dates and
times as ISO text, floating-point numbers rounded to four decimals, counts as 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.schemas import column
from workload.adapters import SQL_VIEWS, Tables


@dataclass(frozen=True)
class Query:
    columns: list[tuple[str, str]]
    build: Callable[[Tables], DataFrame]
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        result = self.build(Tables(spark, sf_dir))
        return result.select(*[_spark(name, kind) for name, kind in self.columns])


# Means of short decimals often end in a 5 right after the last digit shown, where the order of
# summation would decide the rounding. Moving both sides by the same hair avoids that.
NUDGE = 1e-9

REGISTRY: dict[str, Query] = {}


def _spark(name: str, kind: str):
    value = column(name)
    if kind == "f":
        number = value.cast("double")
        shown = F.round(F.when(~F.isnan(number), number) + F.lit(NUDGE), 4) + F.lit(0.0)
    elif kind == "i":
        shown = value.cast("bigint")
    elif kind == "d":
        shown = value.cast("date").cast("string")
    elif kind == "t":
        shown = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    elif kind == "b":
        shown = value.cast("boolean")
    else:
        shown = value.cast("string")
    return shown.alias(name)


def _duckdb(name: str, kind: str) -> str:
    value = f'"{name}"'
    shown = {
        "f": f"round(CASE WHEN NOT isnan(CAST({value} AS DOUBLE)) "
             f"THEN CAST({value} AS DOUBLE) END + {NUDGE}, 4) + 0.0",
        "i": f"CAST({value} AS BIGINT)",
        "d": f"CAST(CAST({value} AS DATE) AS VARCHAR)",
        "t": f"strftime({value}, '%Y-%m-%d %H:%M:%S')",
        "b": f"CAST({value} AS BOOLEAN)",
        "s": f"CAST({value} AS VARCHAR)",
    }[kind]
    return f"{shown} AS {value}"


def _views(names: str) -> list[str]:
    """The adapter views a query reads, with the views those read, in order."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in SQL_VIEWS[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    return ordered


def register(name: str, columns: str, build: Callable[[Tables], DataFrame], reads: str, sql: str):
    """``columns`` is ``name:kind`` words, kinds being f, i, d, t, b and s; ``reads`` names adapter
    views; ``sql`` is a SELECT over them, which may start with its own ``WITH``."""
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    spec = [tuple(word.rsplit(":", 1)) for word in columns.split()]
    shared = [f"{view} AS ({SQL_VIEWS[view][1]})" for view in _views(reads)]
    prefix = f"WITH {', '.join(shared)} " if shared else ""
    shown = ", ".join(_duckdb(column_name, kind) for column_name, kind in spec)
    REGISTRY[name] = Query(spec, build, f"{prefix}SELECT {shown} FROM ({sql}) AS result")
