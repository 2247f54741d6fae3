"""Geometry as a struct column, and expressions over it.

geometry STRUCT<type STRING, parts ARRAY<STRUCT<part INT, ring INT, coords ARRAY<STRUCT<x DOUBLE, y DOUBLE, z DOUBLE>>>>>.
ring is 0 for points, lines and outer rings, from 1 for holes. An empty geometry has no parts; no geometry is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORD = "struct<x:double,y:double,z:double>"
GEOMETRY = f"struct<type:string,parts:array<struct<part:int,ring:int,coords:array<{COORD}>>>>"
LINES, POLYGONS, POINTS = ("LineString", "MultiLineString", "LinearRing"), ("Polygon", "MultiPolygon"), ("Point", "MultiPoint")


def coord(x: Column, y: Column, z: Column | None = None) -> Column:
    z = F.lit(None) if z is None else z
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def of_parts(kind: str, parts: Column) -> Column:
    """A shape of structs (ring, coords), all of one part."""
    return F.struct(F.lit(kind).alias("type"), F.transform(parts, lambda p: F.struct(F.lit(0).alias("part"), p["ring"].alias("ring"), p["coords"].alias("coords"))).alias("parts")).cast(GEOMETRY)


def single_part(kind: str, coords: Column) -> Column:
    """A point, line or polygon of one ring."""
    return F.struct(F.lit(kind).alias("type"), F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), coords.alias("coords"))).alias("parts")).cast(GEOMETRY)


def point(x: Column, y: Column) -> Column:
    return single_part("Point", F.array(coord(x, y)))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return single_part("Polygon", F.array(coord(x0, y0), coord(x1, y0), coord(x1, y1), coord(x0, y1), coord(x0, y0)))


def is_a(geometry: Column, kinds: tuple[str, ...]) -> Column:
    return geometry["type"].isin(*kinds)


def is_empty(geometry: Column) -> Column:
    return F.size(geometry["parts"]) == 0


def coords(geometry: Column) -> Column:
    """All coordinates, part by part."""
    return F.flatten(F.transform(geometry["parts"], lambda p: p["coords"]))


def vertex_count(geometry: Column) -> Column:
    return F.coalesce(F.aggregate(geometry["parts"], F.lit(0), lambda n, p: n + F.size(p["coords"])), F.lit(0))


def _after(c: Column, skip: int) -> Column:
    return F.slice(c, F.lit(1 + skip), F.greatest(F.size(c) - skip, F.lit(0)))


def _steps(c: Column, skip: int = 1) -> Column:
    """Each coordinate but the last `skip`."""
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - skip, F.lit(0)))


def same_place(a: Column, b: Column) -> Column:
    return (a["x"] == b["x"]) & (a["y"] == b["y"]) & a["z"].eqNullSafe(b["z"])


def has_repeated_vertex(geometry: Column) -> Column:
    """Two neighbouring coordinates of a part are equal, z included."""
    repeated = lambda p: F.exists(F.zip_with(_steps(p["coords"]), _after(p["coords"], 1), same_place), lambda same: same)
    return F.coalesce(F.exists(geometry["parts"], repeated), F.lit(False))


def goes_onward(geometry: Column) -> Column:
    """Whether a line of one part goes on in x, or in y, with every coordinate: then none is repeated and it cannot meet itself. False for all else; one look at each coordinate."""
    c, infinite = F.get(geometry["parts"], F.lit(0))["coords"], F.lit(float("inf"))

    def onward(v: Column) -> Column:
        up, down = F.aggregate(v, -infinite, lambda last, a: F.when(a > last, a)), F.aggregate(v, infinite, lambda last, a: F.when(a < last, a))
        return F.when(F.get(v, F.lit(0)) < F.element_at(v, -1), up).otherwise(down).isNotNull()

    return F.coalesce(is_a(geometry, LINES) & (F.size(geometry["parts"]) == 1) & (F.size(c) > 1) & (onward(c["x"]) | onward(c["y"])), F.lit(False))


def planar_length(geometry: Column) -> Column:
    hop = lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
    of_part = lambda p: F.aggregate(F.zip_with(_steps(p["coords"]), _after(p["coords"], 1), hop), F.lit(0.0), lambda s, d: s + d)
    return F.aggregate(geometry["parts"], F.lit(0.0), lambda s, p: s + of_part(p))


def corner_angles(coordinates: Column) -> Column:
    """Degrees at each inner coordinate between its two arms; null where an arm has no length."""
    corners = F.zip_with(F.zip_with(_steps(coordinates, 2), F.slice(coordinates, F.lit(2), F.greatest(F.size(coordinates) - 2, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), _after(coordinates, 2), lambda ab, c: F.struct(ab["a"].alias("a"), ab["b"].alias("b"), c.alias("c")))

    def angle(t: Column) -> Column:
        ux, uy, vx, vy = t["a"]["x"] - t["b"]["x"], t["a"]["y"] - t["b"]["y"], t["c"]["x"] - t["b"]["x"], t["c"]["y"] - t["b"]["y"]
        arms = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
        return F.when(arms > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / F.when(arms > 0, arms))))))

    return F.transform(corners, angle)


def first_sharp_angle(geometry: Column, min_degrees: float) -> Column:
    """The first inner angle below min_degrees, or null."""
    angles = F.flatten(F.transform(geometry["parts"], lambda p: corner_angles(p["coords"])))
    return F.get(F.filter(angles, lambda a: a < min_degrees), F.lit(0))


def bounds(geometry: Column) -> dict[str, Column]:
    all_coords = coords(geometry)
    xs, ys = F.transform(all_coords, lambda c: c["x"]), F.transform(all_coords, lambda c: c["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def ring_area(c: Column) -> Column:
    """Signed, by the shoelace formula around the first coordinate."""
    o = F.get(c, F.lit(0))
    cross = F.zip_with(_steps(c), _after(c, 1), lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))
    return F.aggregate(cross, F.lit(0.0), lambda s, d: s + d) / 2


def area(geometry: Column) -> Column:
    """Outer rings less holes; 0 but for polygons."""
    total = F.aggregate(geometry["parts"], F.lit(0.0), lambda s, p: s + F.when(p["ring"] == 0, F.abs(ring_area(p["coords"]))).otherwise(-F.abs(ring_area(p["coords"]))))
    return F.when(is_a(geometry, POLYGONS), total).otherwise(F.lit(0.0))


def endpoints(geometry: Column) -> Column:
    """An array of the first coordinate of the first part and the last of the last, of parts with two coordinates or more; null if there is none."""
    long_parts = F.filter(geometry["parts"], lambda p: F.size(p["coords"]) >= 2)
    first, last = F.get(long_parts, F.lit(0)), F.element_at(long_parts, -1)
    return F.when(is_a(geometry, LINES) & (F.size(long_parts) > 0), F.array(F.get(first["coords"], F.lit(0)), F.element_at(last["coords"], -1)))


def number_text(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _coord_text(c: Column) -> Column:
    xy = F.concat(number_text(c["x"]), F.lit(" "), number_text(c["y"]))
    return F.when(c["z"].isNull(), xy).otherwise(F.concat(xy, F.lit(" "), number_text(c["z"])))


def wkt(geometry: Column) -> Column:
    """Well-known text of points, lines and polygons, multi-part ones included."""
    part_text = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p["coords"], _coord_text), ", "), F.lit(")"))
    rings = F.array_join(F.transform(geometry["parts"], part_text), ", ")
    polygon_parts = F.transform(F.array_distinct(F.transform(geometry["parts"], lambda p: p["part"])), lambda n: F.concat(F.lit("("), F.array_join(F.transform(F.filter(geometry["parts"], lambda p: p["part"] == n), part_text), ", "), F.lit(")")))
    kind = geometry["type"]
    body = (
        F.when(is_empty(geometry), F.lit("EMPTY"))
        .when(kind.isin("Point", "LineString", "LinearRing"), rings)
        .when(kind == "MultiPolygon", F.concat(F.lit("("), F.array_join(polygon_parts, ", "), F.lit(")")))
        .otherwise(F.concat(F.lit("("), rings, F.lit(")")))
    )
    return F.concat(F.upper(kind), F.lit(" "), body)


def decimals(x: Column) -> Column:
    """Decimal places of a number as it is printed, trailing zeros aside; exponents count."""
    text = F.lower(x.cast("string"))
    mantissa, exponent = F.substring_index(text, "e", 1), F.when(F.contains(text, F.lit("e")), F.substring_index(text, "e", -1).cast("int")).otherwise(F.lit(0))
    fraction = F.regexp_replace(F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise(F.lit("")), "0+$", "")
    return F.greatest(F.lit(0), F.length(fraction) - exponent)


def max_decimals(geometry: Column) -> Column:
    of_coord = lambda c: F.greatest(decimals(c["x"]), decimals(c["y"]), F.coalesce(decimals(c["z"]), F.lit(0)))
    return F.coalesce(F.array_max(F.transform(coords(geometry), of_coord)), F.lit(0))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere of the mean earth radius."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))
