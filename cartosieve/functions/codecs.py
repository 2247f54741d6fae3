"""Geometry from and to text and bytes: well-known text and bytes, GeoJSON."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartosieve.functions import geometry as G

COORD_TYPE = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
PART_TYPE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("coords", T.ArrayType(COORD_TYPE))])
GEOMETRY_TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(PART_TYPE))])
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
NAMES = {name.upper(): name for name in [*KINDS.values(), "LinearRing"]}
TOKEN = re.compile(r"\(|\)|,|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def _nested(text: str) -> list:
    """(a b, c d) as nested lists with numbers inside."""
    stack: list[list] = [[]]
    for token in TOKEN.findall(text):
        if token == "(":
            stack.append([])
        elif token == ")":
            done = stack.pop()
            stack[-1].append(done)
        elif token == ",":
            stack[-1].append(None)
        else:
            stack[-1].append(float(token))
    return stack[0]


def _coords(flat: list) -> list[tuple]:
    """Numbers parted by None -> coordinates."""
    found: list[list[float]] = [[]]
    for x in flat:
        if x is None:
            found.append([])
        else:
            found[-1].append(x)
    return [(c[0], c[1], c[2] if len(c) > 2 else None) for c in found if len(c) >= 2]


def parse_wkt(text: str | None) -> tuple | None:
    """None for blank text and for what is no well-known text of a known kind."""
    m = re.match(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(EMPTY|\(.*\))\s*$", text or "", re.I | re.S)
    if not m or m[1].upper() not in NAMES:
        return None
    kind = NAMES[m[1].upper()]
    if m[2].upper() == "EMPTY":
        return kind, []
    lists = lambda x: [y for y in x if y is not None]
    body = _nested(m[2])[0]
    if kind in ("Point", "LineString", "LinearRing"):
        return kind, [(0, 0, _coords(body))]
    if kind == "MultiPoint":
        points = [_coords(p)[0] for p in lists(body)] if any(isinstance(x, list) for x in body) else _coords(body)
        return kind, [(i, 0, [c]) for i, c in enumerate(points)]
    if kind == "MultiLineString":
        return kind, [(i, 0, _coords(c)) for i, c in enumerate(lists(body))]
    if kind == "Polygon":
        return kind, [(0, r, _coords(c)) for r, c in enumerate(lists(body))]
    return kind, [(i, r, _coords(c)) for i, polygon in enumerate(lists(body)) for r, c in enumerate(lists(polygon))]


def parse_wkb(raw: bytes | None) -> tuple | None:
    """Either byte order, two or three dimensions, with or without an SRID."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        found = struct.unpack_from(form, raw, at)
        at += struct.calcsize(form)
        return found

    def shape() -> tuple[int, list]:
        order = "<" if take("B")[0] else ">"
        (code,) = take(order + "I")
        if code & 0x20000000:
            take(order + "I")
        kind, size = code & 0xFF if code & 0xE0000000 else code % 1000, 3 if code & 0x80000000 or code // 1000 in (1, 3) else 2
        run = lambda n: [(c[0], c[1], c[2] if size == 3 else None) for c in (take(f"{order}{size}d") for _ in range(n))]
        if kind == 1:
            return kind, [(0, 0, run(1))]
        (n,) = take(order + "I")
        if kind == 2:
            return kind, [(0, 0, run(n))] if n else []
        if kind == 3:
            return kind, [(0, r, run(take(order + "I")[0])) for r in range(n)]
        return kind, [(i, r, c) for i in range(n) for _, r, c in shape()[1]]

    if not raw:
        return None
    kind, parts = shape()
    if kind == 1 and any(x != x for x in parts[0][2][0][:2]):
        parts = []
    return KINDS[kind], parts


def wkb(kind: str, parts: list[tuple[int, int, list[tuple]]]) -> bytes:
    """Little-endian well-known bytes of a shape, with z (type code + 1000) if its first coordinate has one."""
    code = {name: n for n, name in KINDS.items()} | {"LinearRing": 2}
    deep = any(c[2] is not None for _, _, cs in parts[:1] for c in cs[:1])
    point = struct.Struct("<3d" if deep else "<2d")
    run = lambda cs: b"".join(point.pack(c[0], c[1], *((c[2] or 0.0,) if deep else ())) for c in cs)
    head = lambda name: struct.pack("<BI", 1, code[name] + 1000 * deep)
    counted = lambda cs: struct.pack("<I", len(cs)) + run(cs)
    if kind == "Point":
        return head(kind) + (run(parts[0][2][:1]) if parts else struct.pack("<2d", float("nan"), float("nan")))
    if kind in ("LineString", "LinearRing"):
        return head("LineString") + (counted(parts[0][2]) if parts else struct.pack("<I", 0))
    if kind == "Polygon":
        return head(kind) + struct.pack("<I", len(parts)) + b"".join(counted(cs) for _, _, cs in parts)
    by_part: dict[int, list] = {}
    for part in parts:
        by_part.setdefault(part[0], []).append(part)
    return head(kind) + struct.pack("<I", len(by_part)) + b"".join(wkb(kind.removeprefix("Multi"), own) for own in by_part.values())


@F.pandas_udf(T.BinaryType())
def to_wkb(geometry: pd.DataFrame) -> pd.Series:
    """Null without geometry."""
    shapes = zip(geometry["type"], geometry["parts"], strict=True)
    return pd.Series([None if kind is None else wkb(kind, [(p["part"], p["ring"], [(c["x"], c["y"], c["z"]) for c in p["coords"]]) for p in parts]) for kind, parts in shapes], dtype=object)


@F.pandas_udf(GEOMETRY_TYPE)
def from_wkt(texts: pd.Series) -> pd.DataFrame:
    return _frame([parse_wkt(t) for t in texts])


@F.pandas_udf(GEOMETRY_TYPE)
def from_wkb(raws: pd.Series) -> pd.DataFrame:
    return _frame([parse_wkb(r) for r in raws])


def _frame(shapes: list) -> pd.DataFrame:
    coords = lambda cs: [{"x": x, "y": y, "z": z} for x, y, z in cs]
    parts = [None if s is None else [{"part": p, "ring": r, "coords": coords(cs)} for p, r, cs in s[1]] for s in shapes]
    return pd.DataFrame({"type": [None if s is None else s[0] for s in shapes], "parts": parts})


#: Evaluated where they stand: their nested results are read several times over.
from_wkt, from_wkb = from_wkt.asNondeterministic(), from_wkb.asNondeterministic()


def or_null(geometry: Column) -> Column:
    """The functions above give a struct of nulls where there is no geometry."""
    return F.when(geometry["type"].isNotNull(), geometry)


def geojson(geometry: Column) -> Column:
    """The geometry member of a GeoJSON feature, as text; null without geometry."""
    pair = lambda c: F.concat(F.lit("["), G.number_text(c["x"]), F.lit(","), G.number_text(c["y"]), F.when(c["z"].isNull(), F.lit("")).otherwise(F.concat(F.lit(","), G.number_text(c["z"]))), F.lit("]"))
    bracket = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    ring = lambda p: bracket(F.transform(p["coords"], pair))
    parts, kind = geometry["parts"], geometry["type"]
    polygons = F.transform(F.array_distinct(F.transform(parts, lambda p: p["part"])), lambda n: bracket(F.transform(F.filter(parts, lambda p: p["part"] == n), ring)))
    body = (
        F.when(F.size(parts) == 0, F.lit("[]"))
        .when(kind == "Point", pair(F.get(F.get(parts, F.lit(0))["coords"], F.lit(0))))
        .when(kind.isin("LineString", "LinearRing"), ring(F.get(parts, F.lit(0))))
        .when(kind == "MultiPoint", bracket(F.transform(parts, lambda p: pair(F.get(p["coords"], F.lit(0))))))
        .when(kind == "MultiPolygon", bracket(polygons))
        .otherwise(bracket(F.transform(parts, ring)))
    )
    name = F.when(kind == "LinearRing", F.lit("LineString")).otherwise(kind)
    return F.when(geometry.isNotNull(), F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), body, F.lit("}")))


def from_geojson(text: Column) -> Column:
    """The geometry member of a GeoJSON feature as the struct, by expressions; null for null and unknown kinds."""
    depth = {"Point": "array<double>", "LineString": "array<array<double>>", "MultiPoint": "array<array<double>>", "Polygon": "array<array<array<double>>>", "MultiLineString": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}
    kind = F.get_json_object(text, "$.type")
    coord = lambda c: G.coord(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2)))
    part = lambda p, r, cs: F.struct(p.cast("int").alias("part"), r.cast("int").alias("ring"), F.transform(cs, coord).alias("coords"))
    zero = F.lit(0)
    read = {name: F.from_json(F.get_json_object(text, "$.coordinates"), form) for name, form in depth.items()}
    shapes = {
        "Point": F.when(F.size(read["Point"]) > 0, F.array(part(zero, zero, F.array(read["Point"])))).otherwise(F.array().cast(f"array<struct<part:int,ring:int,coords:array<{G.COORD}>>>")),
        "LineString": F.array(part(zero, zero, read["LineString"])),
        "MultiPoint": F.transform(read["MultiPoint"], lambda c, i: part(i, zero, F.array(c))),
        "Polygon": F.transform(read["Polygon"], lambda c, i: part(zero, i, c)),
        "MultiLineString": F.transform(read["MultiLineString"], lambda c, i: part(i, zero, c)),
        "MultiPolygon": F.flatten(F.transform(read["MultiPolygon"], lambda polygon, i: F.transform(polygon, lambda c, r: part(i, r, c)))),
    }
    found = F.lit(None).cast(G.GEOMETRY)
    for name, parts in shapes.items():
        found = F.when(kind == name, F.struct(kind.alias("type"), parts.alias("parts")).cast(G.GEOMETRY)).otherwise(found)
    return found
