"""Names, queries, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import CASES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, cases: bool = True) -> Callable[[Query], Query]:
    """Register a query. sql: the same result for DuckDB; with cases, it may read the view of cases."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            s = sql.strip()
            head = next((h for h in ("WITH RECURSIVE ", "WITH ") if s.startswith(h)), None)
            SQL[name] = s if not cases else f"{head}{CASES},\n{s[len(head) :]}" if head else f"WITH {CASES}\n{s}"
        return f

    return add
