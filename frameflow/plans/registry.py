"""Where queries and their SQL are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameflow.sources.scene import SCENE_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def views(sql: str) -> str:
    """The scene's views that a text reads, directly or through one another, in their order."""
    wanted, text = [], sql
    for name, body in reversed(SCENE_VIEWS.items()):
        if re.search(rf"\b{name}\b", text):
            wanted.append(f"{name} AS ({body})")
            text += f" {body}"
    return ",\n".join(reversed(wanted))


def behind(sql: str, recursive: bool) -> str:
    """A text with the scene's views that it reads before it."""
    sql, scene = sql.strip(), views(sql)
    if not scene:
        return f"WITH {'RECURSIVE ' if recursive else ''}{sql[1:].strip()}" if sql.startswith(",") else sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{scene} {sql}"


def query(sql: str | None = None, scene: bool = True, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name. sql: DuckDB text for the same rows, behind those of the scene's views that it reads; a text that
    begins with a comma adds views before its SELECT. recursive: one of its views reads itself."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = behind(sql, recursive) if scene else sql.strip()
        return f

    return add
