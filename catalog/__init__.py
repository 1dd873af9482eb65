"""Registered queries over the given tables, each with SQL of the same meaning where SQL can say it."""

MODULES = ("scalar_queries", "signal_queries", "model_queries", "table_queries", "study_queries", "stream_queries")


def load():
    """Import all query modules and return the registry."""
    import importlib
    import importlib.util

    for name in MODULES:
        if importlib.util.find_spec(f"catalog.{name}"):
            importlib.import_module(f"catalog.{name}")
    return importlib.import_module("catalog.base")
