"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = [
    "curation_queries",
    "report_queries",
    "quoting_queries",
    "evaluation_queries",
    "model_queries",
    "stream_queries",
]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"haulmark.plans.{name}")
