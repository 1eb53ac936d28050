"""Incremental variants of the batch reports (Structured Streaming).

The analyses are batch reports; this package only re-runs the same
DataFrame operators on a file stream of new incident drops, so the
hotspot counts stay current without rescanning history.
"""

from .hotspots import (  # noqa: F401
    incremental_cell_counts,
    read_cell_counts,
    start_cell_counts,
)
