"""Between longitude and latitude, spherical Mercator metres and UTM metres, as expressions. Datums are taken as one."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G

#: The ellipsoid of WGS 84 and UTM's scale and false origin.
RADIUS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
GEOGRAPHIC = (4326, 4269, 4258, 4979)
_n = FLATTENING / (2 - FLATTENING)
_MERIDIAN = RADIUS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
_BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
_DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)
Pair = tuple[Column, Column]


def to_mercator(lon: Column, lat: Column) -> Pair:
    return F.radians(lon) * RADIUS, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> Pair:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def _zone(code: int) -> tuple[float, float] | None:
    """The central meridian and false northing of EPSG 326xx and 327xx."""
    zone = code % 100
    return (math.radians(6 * zone - 183), SOUTH if code // 100 == 327 else 0.0) if code // 100 in (326, 327) and 1 <= zone <= 60 else None


def to_utm(lon: Column, lat: Column, code: int) -> Pair:
    """Krueger's series to the third order, good to a millimetre within the zone."""
    middle, north = _zone(code)
    k, away = 2 * math.sqrt(_n) / (1 + _n), F.radians(lon) - middle
    t = F.sinh(F.atanh(F.sin(F.radians(lat))) - k * F.atanh(k * F.sin(F.radians(lat))))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x * (SCALE * _MERIDIAN) + EAST, y * (SCALE * _MERIDIAN) + north


def from_utm(x: Column, y: Column, code: int) -> Pair:
    middle, north = _zone(code)
    xi, eta = (y - north) / (SCALE * _MERIDIAN), (x - EAST) / (SCALE * _MERIDIAN)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u, v = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u)) + middle), F.degrees(lat)


def steps(source: int, target: int) -> list[Callable[[Column, Column], Pair]]:
    """What takes coordinates of one reference system to another, by way of longitude and latitude."""
    out: list[Callable[[Column, Column], Pair]] = []
    if source == target or (source in GEOGRAPHIC and target in GEOGRAPHIC):
        return out
    for code, mercator, utm in ((source, from_mercator, from_utm), (target, to_mercator, to_utm)):
        if code == 3857:
            out.append(mercator)
        elif _zone(code):
            out.append(lambda x, y, code=code, utm=utm: utm(x, y, code))
        elif code not in GEOGRAPHIC:
            raise ValueError(f"EPSG:{code} is not one of those that can be transformed: 4326, 3857, UTM of WGS 84")
    return out


def transformed(geometry: Column, source: int, target: int) -> Column:
    """The geometry with every coordinate in the other reference system; z stays."""
    for step in steps(source, target):
        geometry = _moved(geometry, step)
    return geometry


def _moved(geometry: Column, step: Callable[[Column, Column], Pair]) -> Column:
    def place(c: Column) -> Column:
        x, y = step(c["x"], c["y"])
        return G.coord(x, y, c["z"])

    parts = F.transform(geometry["parts"], lambda p: F.struct(p["part"].alias("part"), p["ring"].alias("ring"), F.transform(p["coords"], place).alias("coords")))
    return F.when(geometry.isNotNull(), F.struct(geometry["type"].alias("type"), parts.alias("parts")).cast(G.GEOMETRY))
