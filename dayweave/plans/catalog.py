"""Registry of named queries and, where SQL can say it, their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; covers lists the inventory ids it shows."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body


def with_views(body: str) -> str:
    """Prefix a SQL body with the shared views it names, in definition order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(sql)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
