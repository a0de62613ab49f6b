"""Registered queries: one entry per operator, each over the given tables, with its SQL twin."""

from __future__ import annotations

import importlib

from taproom.catalog.base import ENTRIES

SECTIONS = (
    "scans", "filters", "joins", "aggregates", "windows", "scalars", "requests", "evidence",
    "pages", "learning",
)


def entries():
    for section in SECTIONS:
        importlib.import_module(f"taproom.catalog.{section}")
    return ENTRIES
