"""Every query over the label model, with the SQL that gives the same rows."""

from __future__ import annotations

from tagmill.catalog import codes, extraction, shapes, sources, specs, types  # noqa: F401
from tagmill.catalog.registry import FORMS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(FORMS)
