"""The list of registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

# Engines add doubles in different orders; a shift far above that noise and far
# below the kept digits makes a value that falls on a rounding tie go one way.
_TIE = 1e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for comparison with another engine."""
    def one(name: str, dtype: str) -> Column:
        c = F.col(f"`{name}`")
        if dtype != "double":
            return c
        return (F.round(c + F.lit(_TIE), digits) + F.lit(0.0)).alias(name)

    return df.select(*[one(n, t) for n, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """SQL text for the rounding done by ``rounded``."""
    return f"(round(CAST({expr} AS DOUBLE) + {_TIE!r}, {digits}) + 0.0e0)"


def sql_uni(seed: int, salt: str, *keys: str) -> str:
    """SQL text for ``functions.columns.uni``."""
    parts = ", ".join([f"'{seed}'", f"'{salt}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 13) AS BIGINT) / 4503599627370496.0e0)"


def sql_gauss(seed: int, salt: str, *keys: str) -> str:
    u, v = sql_uni(seed, salt + ".a", *keys), sql_uni(seed, salt + ".b", *keys)
    return f"(sqrt(-2.0e0 * ln(1.0e0 - {u})) * cos(6.283185307179586e0 * {v}))"


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the shared table expressions it names, directly or not."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name, cte in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(cte)
    chosen = [f"{n} AS ({t.strip()})" for n, t in CTES.items() if n in needed]
    body = body.strip()
    if not chosen:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH RECURSIVE " + ",\n".join(chosen) + ",\n" + body[5:]
    return "WITH " + ",\n".join(chosen) + "\n" + body


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[QueryFn], QueryFn]:
    """Register a query; its double columns are rounded to ``digits``."""
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return add
