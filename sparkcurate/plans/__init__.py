"""Operators bound to the driver tables, each with its SQL twin."""

from __future__ import annotations

import importlib

from sparkcurate.plans.registry import ORACLES, QUERIES

FAMILIES = [
    "candidates",
    "labels",
    "responses",
    "wording",
    "feeds",
    "steps",
    "masks",
    "places",
    "rows",
    "nested",
    "runlog",
]


def load_all():
    """Import every family once; returns (queries, SQL twins)."""
    for name in FAMILIES:
        importlib.import_module(f"sparkcurate.plans.{name}")
    return QUERIES, ORACLES
