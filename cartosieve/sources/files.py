"""Layers in single binary files: Shapefile, GeoPackage, KML. A file is read by one task; many files are read side by side."""

from __future__ import annotations

import os
import re
import sqlite3
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.functions import codecs
from cartosieve.functions import geometry as G
from cartosieve.operators.layers import LayerMeta, epsg_code

Shape = tuple[str, list] | None
FEATURES = f"path string, feature_pos long, feature_id string, geometry {G.GEOMETRY}, properties map<string,string>"


def _turns_left(ring: list[tuple]) -> bool:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) > 0


def _inside(point: tuple, ring: list[tuple]) -> bool:
    x, y = point[:2]
    odd = False
    for a, b in zip(ring, ring[1:], strict=False):
        if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def _polygons(rings: list[list[tuple]]) -> Shape:
    """Shapefile rings: clockwise ones are outer, the others holes of the first outer ring around them."""
    outer = [r for r in rings if not _turns_left(r)] or rings[:1]
    parts = [(i, 0, r) for i, r in enumerate(outer)]
    held = [0] * len(outer)
    for hole in (r for r in rings if r not in outer):
        i = next((i for i, r in enumerate(outer) if _inside(hole[0], r)), 0)
        held[i] += 1
        parts.append((i, held[i], hole))
    parts.sort(key=lambda p: p[:2])
    return ("Polygon" if len(outer) == 1 else "MultiPolygon"), parts


def read_shapes(shp: bytes) -> Iterator[Shape]:
    """The records of a .shp file: points, multipoints, lines and polygons; z and m are left out."""
    at = 100
    while at + 12 <= len(shp):
        (words,) = struct.unpack_from(">i", shp, at + 4)
        at += 8
        (kind,) = struct.unpack_from("<i", shp, at)
        base = kind % 10
        if base == 1:
            yield "Point", [(0, 0, [(*struct.unpack_from("<2d", shp, at + 4), None)])]
        elif base == 8:
            (n,) = struct.unpack_from("<i", shp, at + 36)
            flat = struct.unpack_from(f"<{2 * n}d", shp, at + 40)
            yield "MultiPoint", [(i, 0, [(x, y, None)]) for i, (x, y) in enumerate(zip(flat[::2], flat[1::2], strict=True))]
        elif base in (3, 5):
            n_parts, n = struct.unpack_from("<2i", shp, at + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", shp, at + 44), n]
            flat = struct.unpack_from(f"<{2 * n}d", shp, at + 44 + 4 * n_parts)
            points = [(x, y, None) for x, y in zip(flat[::2], flat[1::2], strict=True)]
            rings = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            yield _polygons(rings) if base == 5 else (("LineString" if n_parts == 1 else "MultiLineString"), [(i, 0, r) for i, r in enumerate(rings)])
        else:
            yield None
        at += 2 * words


def read_table(dbf: bytes, encoding: str = "utf-8") -> Iterator[dict]:
    """The records of a .dbf file as text; blank is null."""
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), dbf[at + 16]))
        at += 32
    for i in range(n):
        at = head + i * size + 1
        row = {}
        for name, width in fields:
            row[name] = dbf[at : at + width].decode(encoding, "replace").strip(" \0") or None
            at += width
        yield row


def _database(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def _feature_tables(db: sqlite3.Connection) -> list[tuple[str, str, int | None]]:
    """(table, geometry column, code of the reference system if the file has any), by name."""
    code = "g.srs_id" if any(c[1] == "srs_id" for c in db.execute("PRAGMA table_info(gpkg_geometry_columns)")) else "NULL"
    return db.execute(f"SELECT c.table_name, g.column_name, {code} FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) WHERE data_type = 'features' ORDER BY 1").fetchall()


def geopackage_tables(content: bytes) -> list[tuple[str, int | None]]:
    """(name, code of the reference system) of each table of features."""
    db = _database(content)
    found = [(name, code if code and code > 0 else None) for name, _, code in _feature_tables(db)]
    db.close()
    return found


def read_geopackage(content: bytes, layer: str | None = None) -> Iterator[tuple[Shape, dict]]:
    """Features of one table of a GeoPackage, the first by name if none is given."""
    db = _database(content)
    for table, column, _ in [t for t in _feature_tables(db) if layer in (None, t[0])][:1]:
        rows = db.execute('SELECT * FROM "%s"' % table.replace('"', '""'))
        names = [d[0] for d in rows.description]
        for row in rows:
            record = dict(zip(names, row, strict=True))
            raw = record.pop(column)
            envelope = (0, 32, 48, 48, 64)[(raw[3] >> 1) & 7] if raw else 0
            yield (codecs.parse_wkb(raw[8 + envelope :]) if raw and not raw[3] & 16 else None), {k: None if v is None else str(v) for k, v in record.items()}
    db.close()


def read_kml(content: bytes) -> Iterator[tuple[Shape, dict]]:
    """Placemarks with points, lines or polygons; several of one kind are a multi-part shape, of several kinds the first kind counts."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    numbers = lambda e: [(float(c[0]), float(c[1]), float(c[2]) if len(c) > 2 else None) for c in (t.split(",") for t in (e.text or "").split()) if len(c) > 1]
    for mark in (e for e in ET.fromstring(content).iter() if tag(e) == "Placemark"):
        name = next((e.text for e in mark if tag(e) == "name"), None)
        shapes = [e for e in mark.iter() if tag(e) in ("Point", "LineString", "Polygon")]
        if not shapes:
            yield None, {"name": name}
            continue
        kind = tag(shapes[0])
        own = [[numbers(e) for e in shape.iter() if tag(e) == "coordinates"] for shape in shapes if tag(shape) == kind]
        yield (kind if len(own) == 1 else f"Multi{kind}", [(i, k if kind == "Polygon" else 0, r) for i, rings in enumerate(own) for k, r in enumerate(rings)]), {"name": name}


def feature_rows(path: str, found: Iterator[tuple[Shape, dict]]) -> list[tuple]:
    """Rows of FEATURES."""
    parts = lambda s: [{"part": p, "ring": r, "coords": [dict(zip("xyz", c, strict=True)) for c in cs]} for p, r, cs in s[1]]
    return [(path, i, str(i), None if s is None else {"type": s[0], "parts": parts(s)}, dict(a)) for i, (s, a) in enumerate(found)]


#: Names of reference systems in .prj files that carry no code.
PRJ_NAMES = {"GCS_WGS_1984": 4326, "WGS_1984": 4326, "WGS 84": 4326, "GCS_North_American_1983": 4269, "GCS_ETRS_1989": 4258, "WGS_1984_Web_Mercator_Auxiliary_Sphere": 3857}


def prj_crs(text: str | None) -> str | None:
    """EPSG:n of a .prj file: its last authority, its name, or a UTM zone of WGS 84; else the text itself."""
    if not text or not text.strip():
        return None
    if code := epsg_code(text):
        return f"EPSG:{code}"
    name = (re.search(r'"([^"]*)"', text) or [None, ""])[1]
    if name in PRJ_NAMES:
        return f"EPSG:{PRJ_NAMES[name]}"
    if zone := re.fullmatch(r"WGS[_ ](?:19)?84[_ /]+UTM[_ ]zone[_ ](\d+)([NS])", name, re.I):
        return f"EPSG:{(32600 if zone[2].upper() == 'N' else 32700) + int(zone[1])}"
    return text.strip()


def read_files(spark: SparkSession, path: str, layer: str | None = None) -> tuple[DataFrame, LayerMeta]:
    """One .shp (beside its .dbf), .gpkg or .kml file, or a pattern of such files."""
    suffix = os.path.splitext(path)[1].lower()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content, table in zip(batch["path"], batch["content"], batch["table"], strict=True):
                if suffix == ".shp":
                    shapes = list(read_shapes(content))
                    found = zip(shapes, read_table(table) if table is not None else ({} for _ in shapes), strict=False)
                else:
                    found = read_geopackage(content, layer) if suffix == ".gpkg" else read_kml(content)
                if rows := feature_rows(name, found):
                    yield pd.DataFrame(rows, columns=["path", "feature_pos", "feature_id", "geometry", "properties"])

    def references(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                codes = [code for table, code in geopackage_tables(content) if layer in (None, table)][:1]
                yield pd.DataFrame({"crs": [f"EPSG:{c}" for c in codes if c]}, dtype=object)

    folder, name = os.path.split(path)
    beside = lambda other: spark.read.format("binaryFile").option("pathGlobFilter", name[:-4] + other).load(folder or ".")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if suffix == ".shp":
        tables = beside(".dbf").select(F.regexp_replace("path", r"\.dbf$", ".shp").alias("path"), F.col("content").alias("table"))
        files = files.join(tables, "path", "left")
    else:
        files = files.withColumn("table", F.lit(None).cast("binary"))
    crs = "EPSG:4326" if suffix == ".kml" else None
    if suffix == ".gpkg":
        crs = next((r["crs"] for r in files.select("path", "content").limit(1).mapInPandas(references, "crs string").collect()), None)
    elif suffix == ".shp":
        text = beside(".prj").select("content").take(1)
        crs = prj_crs(bytes(text[0]["content"]).decode("utf-8", "replace")) if text else None
    return files.mapInPandas(parse, FEATURES), LayerMeta(os.path.basename(path), path, crs)
