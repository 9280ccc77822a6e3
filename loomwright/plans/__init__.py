"""Whole queries: operators put together over given tables, registered by name."""

from importlib import import_module

MODULES = ("profiling", "corpora", "losses", "monitoring", "evaluation", "linking", "examples")


def load() -> None:
    """Import all query modules, which registers their queries."""
    for name in MODULES:
        import_module(f"loomwright.plans.{name}")
