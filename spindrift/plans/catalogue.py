"""All engine queries and their oracle SQL, gathered from the modules beside this one."""

from __future__ import annotations

from . import extras, nested, relational, rows

_ALL = {**nested.REGISTRY, **relational.REGISTRY, **extras.REGISTRY, **rows.REGISTRY}


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
