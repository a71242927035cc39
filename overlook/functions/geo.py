"""Column functions of position, height and encoding; all run in generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius in metres, refraction coefficient, distance that a full byte stands for.
EARTH_RADIUS = 6371008.8
REFRACTION = 0.13
EFFECTIVE_RADIUS = EARTH_RADIUS / (1 - REFRACTION)
MAX_DISTANCE = 20000.0
NODATA = -32768
MERCATOR_RADIUS = 6378137.0
MERCATOR_LIMIT = 85.05
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def clip(x: Column, low, high) -> Column:
    """``x`` held between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def known(x: Column) -> Column:
    """NaN and infinite values become null: comparisons with NaN are true in Spark, but false where rasters come from."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(north, east) metres a degree at a latitude: WGS84 cosine series."""
    p = F.radians(lat)
    north = F.lit(111132.92) - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p)
    east = 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p)
    return north, east


def metres_per_degree_at(lat: float) -> tuple[float, float]:
    """The same for one latitude, when a plan is laid out."""
    p = math.radians(lat)
    return 111132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p), 111412.84 * math.cos(p) - 93.5 * math.cos(3 * p)


def to_lonlat(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    north, east = metres_per_degree(lat0)
    return lon0 + x / east, lat0 + y / north


def to_xy(lon: Column, lat: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    north, east = metres_per_degree(lat0)
    return (lon - lon0) * east, (lat - lat0) * north


def mercator_y(lat: Column) -> Column:
    """Web Mercator y in radians; latitudes beyond the limit are held there."""
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(clip(lat, -MERCATOR_LIMIT, MERCATOR_LIMIT)) / 2))


def inverse_mercator_y(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y)) - math.pi / 2)


def mercator_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x scales with half the world, y with the radius."""
    return lon / 180 * (math.pi * MERCATOR_RADIUS), mercator_y(lat) * MERCATOR_RADIUS


def bearing(i: int, of: int) -> tuple[float, float]:
    """(east, north) of the i-th of ``of`` bearings, clockwise from north; due east is due east, without a trace of north."""
    turn = 2 * math.pi * i / of
    return round(math.sin(turn), 15) + 0.0, round(math.cos(turn), 15) + 0.0


def curvature_drop(d: Column) -> Column:
    """How far the refracted earth falls away over ``d`` metres."""
    return d * d / (2 * EFFECTIVE_RADIUS)


def elevation_tangent(height: Column, distance: Column, eye: Column) -> Column:
    """The tangent under which a height stands above the eye, earth curvature taken off."""
    return (height - curvature_drop(distance) - eye) / distance


def descent_degrees(z0: Column, z: Column, distance: Column) -> Column:
    return F.degrees(F.atan2(z0 - z, distance))


def quantise_distance(d: Column, farthest: float = MAX_DISTANCE) -> Column:
    """0 to 255 for 0 to ``farthest`` metres, cut down, not rounded."""
    return F.floor(clip(d / farthest * 255, 0.0, 255.0)).cast("int")


def dequantise_distance(q: Column, farthest: float = MAX_DISTANCE) -> Column:
    return q * F.lit(farthest / 255)


def pack_bits(flags: Column) -> Column:
    """An array of booleans as one number, element i in bit i; bit 31 needs a long."""
    bits = F.transform(flags, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def has_bit(mask: Column, i) -> Column:
    return F.call_function("shiftright", mask, F.lit(i)).bitwiseAND(F.lit(1)) == 1


def compass(degrees: Column) -> Column:
    """One of 16 names; halves go to the even one."""
    at = F.pmod(F.rint(degrees / 22.5).cast("int"), F.lit(16))
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), at + 1)


def metres_per_km(degrees: Column) -> Column:
    return F.tan(F.radians(degrees)) * 1000


def slider_position(value: Column, top: float) -> Column:
    """Where a value stands on a square-root scale, 0 to 1; ``slider_value`` is the inverse."""
    return F.sqrt(F.greatest(value, F.lit(0.0)) / top)


def slider_value(position: Column, top: float) -> Column:
    return F.pow(clip(position, 0.0, 1.0), F.lit(2.0)) * top


def half_up(x: Column) -> Column:
    """Halves go up, also below zero; ``F.rint`` sends them to the even number."""
    return F.floor(x + 0.5)


def obstruction(canopy: Column, land_class: Column, built: int = 50, shrub: int = 20, built_m: float = 6.0, shrub_m: float = 2.0) -> Column:
    """Height of what stands on the ground: canopy, at least a building's where built up, at least a shrub's among shrubs."""
    own = F.coalesce(canopy.cast("double"), F.lit(0.0))
    walls = F.when(land_class == built, F.greatest(own, F.lit(built_m))).otherwise(own)
    return F.when((land_class == shrub) & (walls < shrub_m), F.lit(shrub_m)).otherwise(walls)


def land_cover_cell(lat: Column, lon: Column, size: int, tile_degrees: int = 3) -> tuple[Column, Column, Column, Column]:
    """(tile latitude, tile longitude, row from the north, column) of a land-cover tile; cut down and held in the tile."""
    lat0 = (F.floor(lat / tile_degrees) * tile_degrees).cast("int")
    lon0 = (F.floor(lon / tile_degrees) * tile_degrees).cast("int")
    row = clip(F.floor((lat0 + tile_degrees - lat) / tile_degrees * size), 0, size - 1)
    col = clip(F.floor((lon - lon0) / tile_degrees * size), 0, size - 1)
    return lat0, lon0, row.cast("int"), col.cast("int")


def land_cover_name(lat0: Column, lon0: Column) -> Column:
    """A tile's name by its south-west corner, such as N57E012."""
    part = lambda v, plus, minus, n: F.concat(F.when(v >= 0, plus).otherwise(minus), F.lpad(F.abs(v).cast("string"), n, "0"))
    return F.concat(part(lat0, "N", "S", 2), part(lon0, "E", "W", 3))


def is_land(on_water: Column, ground: Column) -> Column:
    """Whether a cell is land: not water, and its height known."""
    return ~F.coalesce(on_water, F.lit(False)) & known(ground.cast("double")).isNotNull()
