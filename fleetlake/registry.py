"""Fixed values that right results depend on, and the names of generated metric columns."""

from __future__ import annotations

# Study area, boxes and thresholds.
CORE_BOX = (39.58, 39.92, -105.25, -104.55)  # south, north, west, east
GLITCH_BOX = (18.0, 54.0, 73.0, 135.0)
METRES_PER_DEGREE = 111_320.0
BUFFER_METRES = 200.0
MOVED_METRES = 16.0
HEX_EDGE = {8: 531.414, 9: 200.786, 10: 75.864}
LOCAL_ZONE = "America/Denver"
#: Built-in vehicle types: id, form factor, use type, highest range in metres.
VEHICLE_TYPES = (("1", "scooter", "standing", 32_473), ("2", "bicycle", "sitting", 45_000), ("3", "scooter", "standing", 40_000), ("4", "bicycle", "sitting", None), ("5", "scooter", "sitting", 32_473))
#: Groups of boundary layers that the core summary counts, in column order.
GROUPS = ("v1", "v2", "er1", "er2", "er3", "er4", "er5", "er6")
#: Dimensions that split each count: column and values.
SPLITS = (("form_factor", ("bicycle", "scooter")), ("use_type", ("sitting", "standing")))
#: Kinds of reports.
REPORT_TYPES = ("damaged", "not_rideable", "failed_start", "parking", "dead_battery")
#: Points by kind of award.
AWARDS = {"report": 10, "scan": 100, "photo": 50, "survey": 20, "discount": 30}


def core_columns() -> list[tuple[str, str | None, str | None, str | None]]:
    """(column, group, split column, split value) of every count of the core summary, in order."""
    out: list[tuple[str, str | None, str | None, str | None]] = [("total_count", None, None, None)]
    out += [(f"total_{value}", None, col, value) for col, values in SPLITS for value in values]
    for g in GROUPS:
        out.append((f"{g}_count", g, None, None))
        out += [(f"{g}_{value}", g, col, value) for col, values in SPLITS for value in values]
    return out
