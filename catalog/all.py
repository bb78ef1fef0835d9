"""The full registry."""

from __future__ import annotations

from catalog import (
    audit_queries,
    evaluation_queries,
    feature_queries,
    model_queries,
    panel_queries,
    scenario_queries,
)
from catalog.registry import Registry

REGISTRY = Registry()
for module in (
    panel_queries,
    feature_queries,
    audit_queries,
    model_queries,
    evaluation_queries,
    scenario_queries,
):
    module.register(REGISTRY)
