"""All registered queries."""

from __future__ import annotations

import importlib

from tarmetric.plans import registry

MODULES = ["q_sources", "q_network", "q_geometry", "q_spatial", "q_rain", "q_risk", "q_routing", "q_intake", "q_study", "q_streaming"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tarmetric.plans.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return registry.oracle_sql()
