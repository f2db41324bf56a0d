"""Positions on a sphere, map tiles, and a grid of cells for distance joins, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
MAX_MERCATOR_LAT = 85.0511


def has_place(lat: Column, lon: Column) -> Column:
    """True where a position is finite and on the globe; never null."""
    good = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & (F.abs(lon) < float("inf"))
    return F.coalesce(good, F.lit(False))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    a = F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2)
    b = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a + b, F.lit(1.0))))


def wrap_lon(lon: Column) -> Column:
    """A longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def mercator(lat: Column, lon: Column, zoom: int = 12) -> tuple[Column, Column]:
    """Position in tile units of a zoom level; x wraps, y is clamped."""
    n = float(2**zoom)
    phi = F.radians(F.greatest(F.least(lat, F.lit(MAX_MERCATOR_LAT)), F.lit(-MAX_MERCATOR_LAT)))
    y = (1 - F.asinh(F.tan(phi)) / math.pi) / 2 * n
    return F.pmod((lon + 180.0) / 360.0 * n, F.lit(n)), y


def tile(lat: Column, lon: Column, zoom: int = 12) -> tuple[Column, Column]:
    """The tile of a position."""
    x, y = mercator(lat, lon, zoom)
    top = 2**zoom - 1
    return F.floor(x).cast("int"), F.greatest(F.least(F.floor(y).cast("int"), F.lit(top)), F.lit(0))


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north of an origin in metres on the origin's WGS84 radii."""
    e2, a = 0.00669437999014, 6378137.0
    s = F.sin(F.radians(lat0))
    w = 1 - e2 * s * s
    meridian, normal = a * (1 - e2) / F.pow(w, 1.5), a / F.sqrt(w)
    return F.radians(wrap_lon(lon - lon0)) * normal * F.cos(F.radians(lat0)), F.radians(lat - lat0) * meridian


def _columns_of(strip: Column, height: float) -> Column:
    """Cells around the circle in a strip of latitude: about as wide as high at its equatorward edge."""
    edge = F.least(F.abs(strip * height), F.abs((strip + 1) * height))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / height).cast("int"))


def cell_of(lat: Column, lon: Column, height: float) -> Column:
    """The grid cell (strip, column) of a position; height in degrees."""
    strip = F.floor(lat / height).cast("int")
    n = _columns_of(strip, height)
    column = F.least(F.floor(F.pmod(lon, F.lit(360.0)) * n / 360.0).cast("int"), n - 1)
    return F.struct(strip.alias("strip"), column.alias("column"))


def cells_within(lat: Column, lon: Column, height: float, radius_m: Column | float) -> Column:
    """Array of all grid cells that a position within radius_m may lie in, each once."""
    reach = F.degrees((F.lit(radius_m) if not isinstance(radius_m, Column) else radius_m) / EARTH_RADIUS_M) * 1.000001
    ratio = F.sin(F.radians(reach)) / F.greatest(F.cos(F.radians(F.least(F.abs(lat), F.lit(90.0)))), F.lit(1e-12))
    around = (F.abs(lat) + reach >= 90) | (ratio >= 1)
    width = F.when(around, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    strips = F.sequence(F.floor((lat - reach) / height).cast("int"), F.floor((lat + reach) / height).cast("int"))

    def cells(strip: Column) -> Column:
        n = _columns_of(strip, height)
        size = 360.0 / n
        turn = F.pmod(lon, F.lit(360.0))
        span = F.sequence(F.floor((turn - width) / size).cast("int"), F.floor((turn + width) / size).cast("int"))
        columns = F.when(2 * width + 2 * size >= 360.0, F.sequence(F.lit(0), n - 1)).otherwise(
            F.transform(span, lambda c: F.pmod(c, n).cast("int"))
        )
        return F.transform(columns, lambda c: F.struct(strip.alias("strip"), c.alias("column")))

    return F.flatten(F.transform(strips, cells))
