"""Every registered query of the analytics part."""

from __future__ import annotations

from . import catalog_cube, catalog_models, catalog_spatial, catalog_stored  # noqa: F401  (register their queries)
from .catalog import CATALOG

__all__ = ["CATALOG"]
