"""Where queries and the SQL that gives the same rows are put down side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def edges(pattern: str) -> str:
    """A pattern for DuckDB in which letters of any script make words; it may take the characters beside a word along."""
    parts, word = pattern.split(r"\b"), r"[\p{L}\p{N}_]"
    out = parts[0]
    for before, after in zip(parts, parts[1:], strict=False):
        opens = after[:1] not in ("", ".", "|", ")")
        out += (f"(?:^|[^{word[1:]})" if opens else f"(?:$|[^{word[1:]})") + after
    return out
