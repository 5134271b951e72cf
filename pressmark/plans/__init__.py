"""All registered queries."""

from importlib import import_module

from pressmark.plans.registry import ORACLES, QUERIES

for _name in ("olap", "matching", "retrieval", "evaluation", "ingest", "streams", "registry_ops", "answers", "files", "building", "reviewing"):
    import_module(f"pressmark.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
