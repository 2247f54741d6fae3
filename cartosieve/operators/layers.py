"""Checks and summaries of a layer as a whole: reference system, metadata, index, extent, inventory."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G

GEOGRAPHIC = {4326, 4269, 4258, 4979}


@dataclass
class LayerMeta:
    """What a source says about a layer beside its rows."""

    name: str = ""
    source_path: str = ""
    crs: str | None = None
    attrs: dict = field(default_factory=dict)
    index_state: str = "absent"


def epsg_code(crs: str | int | None) -> int | None:
    """EPSG:n, urn:ogc:def:crs:EPSG::n, OGC:CRS84, n, or the last authority of a WKT; null if it says none."""
    if crs is None:
        return None
    text = str(crs).strip()
    if re.search(r"CRS:?84$", text, re.I):
        return 4326
    if m := re.fullmatch(r"(?:EPSG:+|urn:ogc:def:crs:EPSG:[^:]*:)?(\d+)", text, re.I):
        return int(m[1])
    found = re.findall(r'(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]', text, re.I)
    return int(found[-1]) if found else None


def _one(spark: SparkSession, problem: str | None, text: str) -> DataFrame:
    schema = "problem_name string, feature_pos long, feature_id string, geometry string, description string"
    return spark.createDataFrame([(problem, None, None, None, text)] if problem else [], schema)


def missing_crs(spark: SparkSession, meta: LayerMeta) -> DataFrame:
    return _one(spark, None if meta.crs else "missing_spatial_reference", "The layer has no reference system.")


def invalid_crs(spark: SparkSession, meta: LayerMeta, expected: str | None = None) -> DataFrame:
    actual, wanted = epsg_code(meta.crs), epsg_code(expected)
    bad = meta.crs is not None and (actual is None or (expected is not None and actual != wanted))
    return _one(spark, "invalid_spatial_reference" if bad else None, f"The layer's reference system is {meta.crs}, not {expected}." if actual else "The layer's reference system cannot be read.")


def metadata_gaps(spark: SparkSession, metadata: dict, fields: tuple[str, ...] = ("title", "abstract", "extent", "lineage")) -> DataFrame:
    gone = [f for f in fields if not str(metadata.get(f) or "").strip()]
    schema = "problem_name string, feature_pos long, feature_id string, geometry string, description string"
    return spark.createDataFrame([(f"missing_metadata_{f}", None, None, None, f"The metadata has no {f}.") for f in gone], schema)


def xy_tolerance(spark: SparkSession, meta: LayerMeta, most: float) -> DataFrame:
    own = meta.attrs.get("xy_tolerance", meta.attrs.get("XY_TOLERANCE"))
    bad = own is not None and float(own) > most
    return _one(spark, "inappropriate_xy_tolerance" if bad else None, f"The layer's tolerance is {own}, above {most:g}.")


def spatial_index(spark: SparkSession, meta: LayerMeta) -> DataFrame:
    status = str(meta.attrs.get("spatial_index_status", meta.attrs.get("index_status", "")))
    bad = status in ("missing", "stale", "needs_rebuild") or meta.index_state == "absent"
    return _one(spark, "missing_or_stale_spatial_index" if bad else None, "The layer has no current spatial index.")


def outdated_index(spark: SparkSession, meta: LayerMeta) -> DataFrame:
    status = str(meta.attrs.get("spatial_index_status", meta.attrs.get("index_status", "")))
    return _one(spark, "outdated_attribute_or_spatial_indexes" if status in ("outdated", "stale", "needs_rebuild") else None, "The layer's index is out of date.")


def non_rfc7946(spark: SparkSession, document: dict | str) -> DataFrame:
    data = json.loads(document) if isinstance(document, str) else document
    return _one(spark, "non_rfc7946_geojson_output" if "crs" in data else None, "The document has a crs member.")


def type_counts(layer: DataFrame) -> DataFrame:
    return layer.groupBy(F.coalesce("geometry.type", F.lit("None")).alias("geometry_type")).agg(F.count(F.lit(1)).alias("n"))


def dominant_type(layer: DataFrame) -> DataFrame:
    """The most frequent geometry type; of equal ones the first by name."""
    return type_counts(layer).orderBy(F.desc("n"), "geometry_type").limit(1)


BUCKETS = 1024


def robust_bounds(layer: DataFrame) -> DataFrame:
    """One row: 2nd and 98th percentile by nearest rank of x and y, the extremes of fewer than 30 positions; nulls without any.

    Exact, by histograms of BUCKETS buckets over both axes at once: the bucket that holds a rank is divided again until it holds one value.
    """
    at = layer.where("geometry is not null").select(F.explode(G.coords(F.col("geometry"))).alias("c")).select("c.x", "c.y")
    whole = at.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}{c}") for c in "xy" for name, f in (("min", F.min), ("max", F.max))]).first()
    cut = 0.02 if whole["n"] >= 30 else 0.0
    names = {"minx": ("x", cut), "miny": ("y", cut), "maxx": ("x", 1 - cut), "maxy": ("y", 1 - cut)}
    found: dict[str, float | None] = dict.fromkeys(names)
    open_ = {name: (c, int(share * (whole["n"] - 1) + 0.5), whole[f"min{c}"], whole[f"max{c}"]) for name, (c, share) in names.items()} if whole["n"] else {}
    while open_:
        for name in [n for n, (_, _, low, high) in open_.items() if low == high]:
            found[name] = open_.pop(name)[2]
        if not open_:
            break
        marks = [F.when(F.col(c).between(low, high), F.struct(F.lit(name).alias("name"), F.least(F.floor((F.col(c) - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1)).alias("b"), F.col(c).alias("v"))) for name, (c, _, low, high) in open_.items()]
        counted = at.select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).groupBy("m.name", "m.b").agg(F.count(F.lit(1)).alias("k"), F.min("m.v").alias("low"), F.max("m.v").alias("high"))
        for row in sorted(counted.collect(), key=lambda r: (r["name"], r["b"])):  # four times BUCKETS rows at most
            c, rank, low, high = open_[row["name"]]
            if rank >= 0:
                open_[row["name"]] = (c, rank - row["k"], low, high) if rank >= row["k"] else (c, -1 - rank, row["low"], row["high"])
        open_ = {name: (c, -1 - rank, low, high) for name, (c, rank, low, high) in open_.items()}
    return layer.sparkSession.createDataFrame([tuple(found[name] for name in names)], ", ".join(f"{name} double" for name in names))


def profile_for(geometry_type: Column, name: Column) -> Column:
    """The profile that a layer's geometry type and name suggest."""
    lower = F.lower(name)
    return (
        F.when(geometry_type.isin(*G.POINTS), "point_asset_quick")
        .when(geometry_type.isin(*G.LINES) & lower.rlike("water|pipe|main|sewer"), "water_network_quick")
        .when(geometry_type.isin(*G.LINES), "line_network_quick")
        .when(geometry_type.isin(*G.POLYGONS) & lower.rlike("zoning|land|parcel"), "land_use_quick")
        .when(geometry_type.isin(*G.POLYGONS), "boundaries_quick")
        .otherwise("generic_quick")
    )


def sample(layer: DataFrame, n: int) -> DataFrame:
    """The first n features in source order."""
    return layer.orderBy("feature_pos").limit(n)


def epsg_of(crs: Column) -> Column:
    """The code of EPSG:n, urn:ogc:def:crs:EPSG::n or n; null if there is none."""
    code = F.regexp_extract(F.trim(crs), r"(?i)^(?:EPSG:+|urn:ogc:def:crs:EPSG:[^:]*:)?(\d+)$", 1)
    return F.when(F.trim(crs).rlike("(?i)CRS:?84$"), F.lit(4326)).when(code != "", code.cast("int"))


def crs_review(inventory: DataFrame, expected: int = 4326) -> DataFrame:
    """(layer_id, epsg, status): missing, unreadable, other than expected, or ok."""
    code = epsg_of(F.col("crs"))
    status = F.when(F.col("crs").isNull(), "missing").when(code.isNull(), "unreadable").when(code != expected, "other").otherwise("ok")
    return inventory.select("layer_id", code.alias("epsg"), status.alias("status"))


def inventory_issues(inventory: DataFrame) -> DataFrame:
    """(layer_id, problem_name): missing metadata, index and reference-system problems of each layer of an inventory."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = [
        (blank("title"), "missing_metadata_title"), (blank("extent"), "missing_metadata_extent"), (F.col("crs").isNull(), "missing_spatial_reference"),
        (F.col("crs").isNotNull() & epsg_of(F.col("crs")).isNull(), "invalid_spatial_reference"), (F.col("index_status").isin("missing", "stale", "needs_rebuild"), "missing_or_stale_spatial_index"),
        (F.col("index_status").isin("outdated", "stale", "needs_rebuild"), "outdated_attribute_or_spatial_indexes"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in checks]), lambda p: p.isNotNull())
    return inventory.select("layer_id", F.explode(found).alias("problem_name"))
