"""All registered queries with the SQL that checks them."""

from importlib import import_module

from tidebars.catalog.base import ORACLES, QUERIES

for _name in ("storage", "checks", "smoothing", "holes", "trading", "alignment", "ranking", "live"):
    import_module(f"tidebars.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
