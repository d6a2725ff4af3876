"""Registry of the document queries and of the SQL that gives the same rows."""

from __future__ import annotations

from .plans import views

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, view: bool = True):
    """Register a query and its SQL, which may use the views of :data:`views.SQL_LINES`."""

    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = _with_views(sql) if view else sql
        return f

    return keep


def _with_views(sql: str) -> str:
    shared = views.SQL_LINES
    if sql.startswith("WITH RECURSIVE "):
        shared, sql = shared.replace("WITH ", "WITH RECURSIVE ", 1), "WITH " + sql[15:]
    return shared + (", " + sql[5:] if sql.startswith("WITH ") else sql)
