"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

from qaloom.plans.registry import QUERIES, SQL

for _name in ("panels", "relations", "similarity", "statistics", "texts", "samples", "replies", "code_domain", "storage", "people", "merging", "generated"):
    importlib.import_module(f"qaloom.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
