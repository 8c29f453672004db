"""Registry of named queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hyplab.plans.oracle_views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Same types on both sides of a comparison: long, double rounded to 6 places, string, boolean."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _r6(sql: str) -> str:
    """Expand ``R6(expr)`` to a cast and rounding to six places."""
    while (at := sql.find("R6(")) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body = sql[at + 3 : end - 1]
        sql = f"{sql[:at]}(round(CAST({body} AS DOUBLE), 6) + CAST(0 AS DOUBLE)){sql[end:]}"
    return sql


def with_views(sql: str) -> str:
    """Prepend the derived views that the statement uses, directly or through other views."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(body)
    ctes = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed]
    body = sql.strip()
    if not ctes:
        return _r6(body)
    if body.upper().startswith("WITH RECURSIVE "):
        return _r6("WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:])
    if body.upper().startswith("WITH "):
        return _r6("WITH " + ",\n".join(ctes) + ",\n" + body[5:])
    return _r6("WITH " + ",\n".join(ctes) + "\n" + body)


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return fn

    return register
