"""Registered queries over the given tables, each with its DuckDB twin where SQL can express it."""

from importlib import import_module

AREAS = ("vectors", "matching", "gates", "frames", "tracks", "names", "workflow", "compare", "catalog", "logs", "sets", "streams", "lifecycles", "files")


def load():
    from vidspark.checks import registry

    for area in AREAS:
        import_module(f"vidspark.checks.{area}")
    return registry.QUERIES, registry.ORACLES
