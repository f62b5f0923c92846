"""Registered queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from ..catalog import TABLES
from . import files_and_functions
from .own_sql import DIALECT, FRAMES, dialect_query
from .shared_sql import SHARED


FRAMES = FRAMES | files_and_functions.FRAMES


def _plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{{", "{").replace("}}", "}").strip()


QUERIES = {name: dialect_query(sql) for name, sql in SHARED.items()} | {name: dialect_query(spark) for name, (spark, _) in DIALECT.items()} | {name: run for name, (run, _) in FRAMES.items()}
SQL = {name: _plain(sql) for name, sql in SHARED.items()} | {name: _plain(duck) for name, (_, duck) in (DIALECT | FRAMES).items()}

pricing_summary = QUERIES["pricing_summary"]
