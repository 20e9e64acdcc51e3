"""Registered queries over the test tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import importlib

MODULES = ("reads", "kmers", "intervals", "overlaps", "correction", "trimming", "graph", "layouts", "kernels", "formats", "assembly")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for m in MODULES:
        module = importlib.import_module(f"{__name__}.{m}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle


def register(queries: dict, oracle: dict):
    """Decorator: adds a query under its function's name, with its SQL."""

    def named(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return named
