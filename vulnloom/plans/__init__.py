"""Runnable plans: the binding of the driver tables and the registered queries."""

import importlib

_MODULES = ["core", "texts", "lookups", "sharing", "forecasts", "firmware", "reports", "learning", "files", "indexes", "streams"]


def load_all():
    """Import every query module, so that the registry is complete."""
    from vulnloom.plans import registry
    for name in _MODULES:
        importlib.import_module(f"vulnloom.plans.{name}")
    return registry
