"""Layers in ZIP and KMZ archives: safety, which member counts, and what layers there are. Archives are read by tasks, members in memory."""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.functions import codecs
from cartosieve.operators.layers import LayerMeta
from cartosieve.sources import files

MAX_MEMBERS, MAX_BYTES, MAX_RATIO = 200, 512 << 20, 200
AUDIT_MEMBERS, AUDIT_BYTES = 1000, 2048 << 20
#: Which kinds of member count first, and which layers of a file with several.
MEMBER_ORDER = (".shp", ".kml", ".geojson", ".json", ".gpkg", ".csv")
PREFERRED_LAYERS = ("multipolygons", "lines", "multilinestrings", "points", "other_relations")
INVENTORY = "archive_name string, layer_path string, layer_name string, kind string"


def unsafe(archive: zipfile.ZipFile, max_members: int = MAX_MEMBERS, max_bytes: int = MAX_BYTES) -> list[str]:
    """Why an archive should not be unpacked; empty if it may be."""
    found, members = [], archive.infolist()
    if len(members) > max_members:
        found.append(f"more than {max_members} members")
    if sum(m.file_size for m in members) > max_bytes:
        found.append(f"more than {max_bytes} bytes")
    for m in members:
        if m.filename.startswith(("/", "\\")) or ".." in m.filename.replace("\\", "/").split("/") or m.filename[1:2] == ":":
            found.append(f"unsafe name {m.filename}")
        if m.flag_bits & 1:
            found.append(f"encrypted {m.filename}")
        if m.file_size > MAX_RATIO * max(1, m.compress_size):
            found.append(f"compressed too much: {m.filename}")
    return found


def chosen_member(names: list[str]) -> str:
    """The member that is the archive's layer. Several Shapefiles are an error, as is none of the known kinds."""
    for suffix in MEMBER_ORDER:
        own = sorted(n for n in names if n.lower().endswith(suffix))
        if suffix == ".shp" and len(own) > 1:
            raise ValueError("the archive holds several Shapefiles; give one layer to an archive")
        if own:
            return own[0]
    raise ValueError("the archive holds no layer of a known kind")


def resolve_bundle(names: list[str]) -> str:
    """The file of an upload that is to be read: a lone file, or the one Shapefile among its sidecar files."""
    if not names:
        raise ValueError("no files were given")
    lower = {n.lower() for n in names}
    if len(names) == 1:
        if names[0].lower().endswith(".shp"):
            raise ValueError("a Shapefile needs its sidecar files too")
        return names[0]
    own = sorted(n for n in names if n.lower().endswith(".shp"))
    if len(own) != 1:
        raise ValueError("several files must hold exactly one .shp")
    missing = [s for s in (".dbf", ".shx") if own[0].lower()[:-4] + s not in lower]
    if missing:
        raise ValueError(f"the Shapefile lacks {', '.join(missing)}")
    return own[0]


def default_layer(names: list[str]) -> str | None:
    lower = {n.lower(): n for n in reversed(names)}
    return next((lower[p] for p in PREFERRED_LAYERS if p in lower), names[0] if names else None)


def _geojson_shape(geometry: dict | None) -> files.Shape:
    if not geometry or geometry.get("type") not in codecs.KINDS.values():
        return None
    point = lambda c: (float(c[0]), float(c[1]), float(c[2]) if len(c) > 2 else None)
    kind, c = geometry["type"], geometry.get("coordinates") or []
    if kind == "Point":
        return kind, [(0, 0, [point(c)])] if c else []
    if kind == "LineString":
        return kind, [(0, 0, [point(p) for p in c])]
    if kind == "MultiPoint":
        return kind, [(i, 0, [point(p)]) for i, p in enumerate(c)]
    if kind == "MultiLineString":
        return kind, [(i, 0, [point(p) for p in line]) for i, line in enumerate(c)]
    polygons = [c] if kind == "Polygon" else c
    return kind, [(i, r, [point(p) for p in ring]) for i, polygon in enumerate(polygons) for r, ring in enumerate(polygon)]


def _text_of(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def read_member(name: str, read: Callable[[str], bytes | None], layer: str | None, x_names: list[str], y_names: list[str], wkt_names: list[str]) -> Iterator[tuple[files.Shape, dict]]:
    """The features of one member; read gives any member's bytes."""
    suffix, content = os.path.splitext(name)[1].lower(), read(name) or b""
    if suffix == ".shp":
        table = read(name[:-4] + ".dbf")
        shapes = list(files.read_shapes(content))
        yield from zip(shapes, files.read_table(table) if table else ({} for _ in shapes), strict=False)
    elif suffix == ".gpkg":
        yield from files.read_geopackage(content, layer)
    elif suffix == ".kml":
        yield from files.read_kml(content)
    elif suffix in (".geojson", ".json"):
        for feature in json.loads(content).get("features", []):
            yield _geojson_shape(feature.get("geometry")), {k: _text_of(v) for k, v in (feature.get("properties") or {}).items()}
    else:
        rows = csv.DictReader(io.StringIO(content.decode("utf-8-sig", "replace")))
        own = {c.lower(): c for c in reversed(rows.fieldnames or [])}
        wkt, x, y = (next((own[n] for n in names if n in own), None) for names in (wkt_names, x_names, y_names))
        for row in rows:
            shape = codecs.parse_wkt(row.pop(wkt)) if wkt else None
            if not wkt and x and y:
                try:
                    shape = ("Point", [(0, 0, [(float(row[x]), float(row[y]), None)])])
                except (TypeError, ValueError):
                    shape = None
            yield shape, {k: v or None for k, v in row.items() if k}


def read_archives(spark: SparkSession, path: str, layer: str | None = None, x_names: tuple = (), y_names: tuple = (), wkt_names: tuple = ()) -> tuple[DataFrame, LayerMeta]:
    """One .zip or .kmz, or a pattern of such files, an archive to a task. Unsafe archives are an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if reasons := unsafe(archive):
                        raise ValueError(f"{name} is not safe to unpack: {'; '.join(reasons[:3])}")
                    names = {n.lower(): n for n in archive.namelist() if not n.endswith("/")}
                    own = [n for n in names.values() if not name.lower().endswith(".kmz") or n.lower().endswith(".kml")]
                    read = lambda n, archive=archive, names=names: archive.read(names[n.lower()]) if n.lower() in names else None
                    found = read_member(chosen_member(own), read, layer, list(x_names), list(y_names), list(wkt_names))
                    if rows := files.feature_rows(name, found):
                        yield pd.DataFrame(rows, columns=["path", "feature_pos", "feature_id", "geometry", "properties"])

    layer_ = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, files.FEATURES)
    return layer_, LayerMeta(os.path.basename(path), path, "EPSG:4326" if path.lower().endswith(".kmz") else None)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(archive_name, layer_path, layer_name, kind): every layer of an archive, a folder, a GeoPackage, or the one file itself."""
    base = os.path.basename(path.rstrip("/"))
    suffix = os.path.splitext(base)[1].lower()

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        if reasons := unsafe(archive, AUDIT_MEMBERS, AUDIT_BYTES):
                            raise ValueError(f"{name} is not safe to unpack: {'; '.join(reasons[:3])}")
                        rows = [(os.path.basename(name), m[:-4], os.path.basename(m)[:-4], "shp") for m in sorted(archive.namelist()) if m.lower().endswith(".shp")]
                else:
                    rows = [(os.path.basename(name), table, table, "gpkg") for table, _ in files.geopackage_tables(content)]
                yield pd.DataFrame(rows, columns=["archive_name", "layer_path", "layer_name", "kind"])

    if suffix in (".zip", ".gpkg"):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, INVENTORY)
    if suffix:
        return spark.createDataFrame([(base, base, base[: -len(suffix)], suffix[1:])], INVENTORY)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    inside = F.regexp_replace(F.substring_index("path", f"/{base}/", -1), "%20", " ")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    named = listed.select(inside.alias("inside"), kind.alias("kind")).where(F.col("kind").isin("shp", "geojson", "json"))
    return named.select(F.lit(base).alias("archive_name"), F.when(F.col("kind") == "shp", F.regexp_replace("inside", r"\.[^.]+$", "")).otherwise(F.col("inside")).alias("layer_path"), F.regexp_replace(F.substring_index("inside", "/", -1), r"\.[^.]+$", "").alias("layer_name"), "kind")
