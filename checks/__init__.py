"""Registered queries: one per operator, each with equal SQL where SQL can say it.

The tables at hand hold no game records, so the operators run on views of them (``views``): orders as
games, user days of events as step sequences, and record texts that Spark writes from orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def load() -> None:
    from checks import columns, dims, explorer, judging, search, sequences, sources, star, tables, text  # noqa: F401
