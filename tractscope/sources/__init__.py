"""Readers, writers and the test-table fixtures."""

from .files import (  # noqa: F401
    read_incidents_csv,
    read_table,
    read_tracts_csv,
    type_by_name,
    write_csv,
    write_table,
)
from .fixtures import (  # noqa: F401
    incidents_from_orders,
    load_incidents,
    load_tracts,
    tracts_from_supplier,
)
