"""Column expressions (JVM-side, codegen friendly); no Python UDFs."""

from .columns import (  # noqa: F401
    day_part,
    grid_index,
    haversine_km,
    hex_cell,
    hex_center,
    hour_from_hhmm,
    parse_date_text,
    parse_money,
    region_of_area,
    stable_share,
    weapon_flag,
)
