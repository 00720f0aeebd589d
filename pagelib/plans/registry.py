"""Queries and their SQL twins, registered side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelib.plans.tables import SQL_VIEWS, Tables
from pagelib.session import bound_batches, configure

# Views that a twin reads several times, or that cost much.
MATERIALIZED = {"search_docs", "matched_docs", "term_counts", "term_idf", "keyword_scores", "label_queries", "q3_scores", "fused", "hits",
                "merged_hits", "chunk_states", "chunk_scores", "asked_docs", "asked_scores", "asked_fused", "asked_hits"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix `sql` with the adapter views it uses, in dependency order."""
    own = set(re.findall(r"(\w+) AS \(", sql))   # names the query defines itself
    order: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in order and name not in own and re.search(rf"\b{name}\b", text):
                visit_view(name)

    def visit_view(name: str) -> None:
        body = SQL_VIEWS[name]
        for other in SQL_VIEWS:
            if other != name and other not in order and re.search(rf"\b{other}\b", body):
                visit_view(other)
        if name not in order:
            order.append(name)

    visit(sql)
    if not order:
        return sql
    views = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({SQL_VIEWS[n]})" for n in order)
    text = sql.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {views},\n{text[5:]}"
    return f"WITH {views}\n{text}"


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`, with its SQL twin if it has one."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(bound_batches(configure(spark)), sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
