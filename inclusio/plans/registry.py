"""Registry of named queries: Spark builder + optional oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    bench: bool = False


REGISTRY: dict[str, Query] = {}


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; Spark's is BIGINT: cast every call."""
    out, i, tag = [], 0, "count_if("
    while True:
        j = sql.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tag)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def register(name: str, sql: str | Callable[[], str] | None = None, bench: bool = False):
    def deco(fn):
        text = sql() if callable(sql) else sql
        REGISTRY[name] = Query(name, fn, bigint_counts(text) if text else text, bench)
        return fn
    return deco


def r6(c) -> Column:
    """Round a double to 6 decimals (both engines round the same way)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
