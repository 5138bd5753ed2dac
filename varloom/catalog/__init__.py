"""Registered queries, each next to the DuckDB statement that checks it."""

from importlib import import_module
from pathlib import Path

from varloom.catalog.base import ORACLES, QUERIES
from varloom.catalog.sql import compose

for _path in sorted(Path(__file__).parent.glob("*.py")):
    if _path.stem not in ("__init__", "base", "sql"):
        import_module(f"varloom.catalog.{_path.stem}")

# Shared expressions may be defined in any module, so statements are put together once all are loaded.
for _name, _sql in ORACLES.items():
    ORACLES[_name] = compose(_sql)

__all__ = ["ORACLES", "QUERIES"]
