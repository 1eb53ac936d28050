"""Query plans: the registered catalog, its SQL oracles and the flagship."""

from .registry import CATALOG  # noqa: F401
