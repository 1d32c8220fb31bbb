"""All queries of the library by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import metric_queries, panel_queries, spatial_queries, support_queries


def _modules():
    return [panel_queries, metric_queries, spatial_queries, support_queries]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for module in _modules():
        out.update({name: pair[0] for name, pair in module.QUERIES.items()})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out.update({name: pair[1] for name, pair in module.QUERIES.items() if pair[1]})
    return out
