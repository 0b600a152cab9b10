"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ["retrieval", "intake", "text", "evaluation", "training", "prompts"]


def load():
    """Import all families and return the registry."""
    for family in FAMILIES:
        importlib.import_module(f"seekwell.checks.{family}")
    from seekwell.checks import registry

    return registry
