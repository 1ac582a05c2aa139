"""Registered queries by area."""

from __future__ import annotations

import importlib

AREAS = ("views", "traffic", "anomaly", "scores", "od", "ingest", "graph", "documents", "quality", "streams")


def load_all():
    from headway.plans.registry import REGISTRY

    for area in AREAS:
        importlib.import_module(f"headway.plans.{area}")
    return REGISTRY
