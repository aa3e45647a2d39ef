"""Named queries over the driver's tables and their SQL forms."""

from __future__ import annotations

from importlib import import_module

from glyphmill.plans.registry import Query

MODULES = ["parsing", "gate", "context", "pages", "replies", "lexicon", "layout", "evaluation", "measures", "policy"]


def _registers() -> list:
    return [import_module(f"glyphmill.plans.{m}").query for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: v for r in _registers() for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _registers() for k, v in r.sql.items()}
