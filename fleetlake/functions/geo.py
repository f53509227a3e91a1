"""Flat-earth distances, polygons as edge arrays, planar hexagons: column expressions only."""

from __future__ import annotations

from math import cos, radians, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import CORE_BOX, HEX_EDGE, METRES_PER_DEGREE

TILE = 0.02
LAT0, LON0 = 39.75, -104.9


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a flat earth, with the cosine at the middle latitude."""
    dx = (lon2 - lon1) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians((lat1 + lat2) / F.lit(2.0)))
    dy = (lat2 - lat1) * F.lit(METRES_PER_DEGREE)
    return F.sqrt(dx * dx + dy * dy)


def metres_at_current(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance with the cosine at the second latitude, as the pair analysis has it."""
    dx = (lon2 - lon1) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat2))
    dy = (lat2 - lat1) * F.lit(METRES_PER_DEGREE)
    return F.sqrt(dx * dx + dy * dy)


def inside(edges: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule over all edges of all rings; points on an edge are undefined."""

    def cross(n: Column, e: Column) -> Column:
        over = (e["y1"] > lat) != (e["y2"] > lat)
        left = lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return n + F.when(over & left, 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), cross) % 2 == 1


def edge_metres(edges: Column, lat: Column, lon: Column) -> Column:
    """Distance of a point to the nearest edge."""

    def one(e: Column) -> Column:
        k = F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))
        ax, ay = (e["x1"] - lon) * k, (e["y1"] - lat) * F.lit(METRES_PER_DEGREE)
        bx, by = (e["x2"] - lon) * k, (e["y2"] - lat) * F.lit(METRES_PER_DEGREE)
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / n))).otherwise(F.lit(0.0))
        px, py = ax + t * dx, ay + t * dy
        return F.sqrt(px * px + py * py)

    return F.array_min(F.transform(edges, one))


def tile(col: Column) -> Column:
    """Grid number of a coordinate."""
    return F.floor(col / F.lit(TILE)).cast("int")


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = CORE_BOX) -> Column:
    """Whether a point lies in a box, all sides included."""
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def hex_cell(lat: Column, lon: Column, resolution: int) -> Column:
    """(q, r) of a planar hexagon: axial coordinates by cube rounding."""
    size = HEX_EDGE[resolution]
    x = (lon - F.lit(LON0)) * F.lit(METRES_PER_DEGREE * cos(radians(LAT0)))
    y = (lat - F.lit(LAT0)) * F.lit(METRES_PER_DEGREE)
    q, r = (F.lit(sqrt(3.0) / 3.0) * x - y / F.lit(3.0)) / F.lit(size), (F.lit(2.0 / 3.0) * y) / F.lit(size)
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q, fix_r = (dq > dr) & (dq > ds), dr > ds
    out_q = F.when(fix_q, -rr - rs).otherwise(rq)
    out_r = F.when(~fix_q & fix_r, -rq - rs).otherwise(rr)
    return F.struct(out_q.cast("long").alias("q"), out_r.cast("long").alias("r"))


def hex_name(cell: Column) -> Column:
    """A cell as text."""
    return F.concat(cell["q"].cast("string"), F.lit(":"), cell["r"].cast("string"))


def ring(cell: Column, k: int) -> Column:
    """The cell and its neighbours within k steps."""
    offsets = [(q, r) for q in range(-k, k + 1) for r in range(-k, k + 1) if abs(q + r) <= k]
    return F.array(*[F.struct((cell["q"] + q).alias("q"), (cell["r"] + r).alias("r")) for q, r in offsets])
