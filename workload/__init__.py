"""Registered queries over the driver's tables, each with its SQL where SQL can state it."""

import importlib

MODULES = ["bars", "signals", "orders", "streams"]


def load_all():
    """(queries, oracles) by name."""
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    from workload.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
