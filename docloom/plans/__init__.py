"""Registered queries by theme: name -> (query, oracle SQL or None)."""

from __future__ import annotations

import importlib

THEMES = ["retrieval", "segments", "graph", "kg", "faq", "chat", "texts", "layout", "ingest", "images", "streams", "agents", "modal"]


def catalogue() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for theme in THEMES:
        out |= importlib.import_module(f"docloom.plans.{theme}").QUERIES
    return out
