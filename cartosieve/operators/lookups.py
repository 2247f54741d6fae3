"""What reviewers look up: the feature of an issue, records side by side, kinds of issues, signatures of layers and catalogs."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G
from cartosieve.functions import projections
from cartosieve.operators import layers

#: Names of issues by what they are about.
OPERATIONAL = ("validation_runtime_error", "runtime_limit_exceeded", "thermal_limit_exceeded", "budget_limited")
LAYER_LEVEL = ("missing_spatial_reference", "invalid_spatial_reference", "missing_or_stale_spatial_index", "outdated_attribute_or_spatial_indexes", "inappropriate_xy_tolerance", *OPERATIONAL)
ENDPOINT, DUPLICATE = "(?i)near_miss_endpoint|unsnapped_endpoint|line_dangle|isolated_network_segment|endpoint", r"(?i)duplicate|same[_\s-]*geometry|same[_\s-]*location"
NETWORK, SERVICE = "(?i)endpoint|node|network|connect|spatial_index|stale_spatial_index|isolated", "(?i)service|lateral|meter|fitting|facility|customer|connection|hydrant|valve"
ID_FIELDS = ("id", "ID", "fid", "FID", "objectid", "OBJECTID")
#: Columns that tell a dataset's kind, in the order in which they are tried.
DATASET_COLUMNS = {
    "water_network": ("pipe_diameter", "valve_id", "hydrant_id", "asset_id"), "flood_zones": ("flood_zone_id", "fema_zone", "base_flood_elev", "flood_risk"),
    "land_use": ("land_use", "zoning", "parcel_use", "landuse"), "environmental": ("habitat_type", "species", "protected_area", "conservation_status"),
}
DMA_NAMES = ("dma", "dma_name", "dma_nm", "dma_label", "name", "district", "zone")
DMA_CREATED, DMA_ADMIN = ("created", "created_at", "creation_date", "date_created", "timestamp"), ("admin", "admin_name", "office", "district", "region", "governorate")
CATEGORIES, SEVERITIES = ("geometry", "topology", "attributes", "accuracy", "crs", "metadata", "integrity", "runtime"), ("low", "medium", "high", "critical")


def is_operational(problem: Column) -> Column:
    return F.coalesce(problem, F.lit("")).isin(*OPERATIONAL)


def is_endpoint_issue(problem: Column) -> Column:
    return F.coalesce(problem, F.lit("")).rlike(ENDPOINT)


def is_duplicate_issue(problem: Column, description: Column) -> Column:
    return F.concat(F.coalesce(problem, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))).rlike(DUPLICATE)


def is_layer_level(problem: Column, feature_id: Column) -> Column:
    return F.coalesce(problem, F.lit("")).isin(*LAYER_LEVEL) | F.coalesce(problem, F.lit("")).contains("metadata") | feature_id.isNull()


def reading(problem: Column, description: Column, layer_name: Column) -> Column:
    """How a finding should be read: duplicate, index, coverage, precision, network_context or review."""
    name = F.lower(F.coalesce(problem, F.lit("")))
    return (
        F.when(is_duplicate_issue(problem, description), "duplicate").when(name.contains("missing_or_stale_spatial_index"), "index").when(name.contains("gap") | name.contains("overlap"), "coverage")
        .when(name.contains("precision"), "precision").when(name.rlike(NETWORK) & F.coalesce(layer_name, F.lit("")).rlike(SERVICE), "network_context").otherwise("review")
    )


def slug(text: Column) -> Column:
    """Safe as a file's name: runs of other characters are one underscore, without dots and underscores at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")


def issue_features(layer: DataFrame, issues: DataFrame) -> DataFrame:
    """(issue_id, feature_pos): the first feature that an issue's feature_id names, by any of its identifiers or its place; else the first with the issue's geometry.

    Identifiers and shapes are equi-joined; a value that very many features share is one row of the side that issues meet.
    """
    own = [F.col(c).cast("string") for c in ID_FIELDS if c in layer.columns] + [F.col("feature_id").cast("string"), F.col("feature_pos").cast("string"), (F.col("feature_pos") + 1).cast("string")]
    by_id = layer.select("feature_pos", F.explode(F.array_distinct(F.array(*own))).alias("key")).groupBy("key").agg(F.min("feature_pos").alias("by_id"))
    by_shape = layer.where("geometry is not null").groupBy(G.wkt(F.col("geometry")).alias("shape")).agg(F.min("feature_pos").alias("by_shape"))
    asked = issues.select("issue_id", F.col("feature_id").cast("string").alias("key"), F.col("geometry").alias("shape"))
    found = asked.join(by_id, "key", "left").join(by_shape, "shape", "left")
    return found.select("issue_id", F.coalesce("by_id", "by_shape").alias("feature_pos"))


def side_by_side(layer: DataFrame, pairs: DataFrame, most: int = 12) -> DataFrame:
    """pairs(a, b) -> (a, b, field, left, right, differs): the first `most` attributes by name of two records."""
    fields = sorted(c for c in layer.columns if c not in ("feature_pos", "geometry") and not c.startswith("_"))[:most]
    shown = layer.select("feature_pos", F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in fields]).alias("cells"))
    side = lambda s: shown.select(F.col("feature_pos").alias(s), F.col("cells").alias(f"cells_{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    rows = both.select("a", "b", F.explode(F.arrays_zip("cells_a", "cells_b")).alias("c"))
    return rows.select("a", "b", F.col("c.cells_a.field").alias("field"), F.col("c.cells_a.value").alias("left"), F.col("c.cells_b.value").alias("right"), (F.col("c.cells_a.value") != F.col("c.cells_b.value")).alias("differs"))


def signature(layer: DataFrame, meta: layers.LayerMeta) -> DataFrame:
    """One row: row_count, columns, crs, source_path, geometry_types (null: "None")."""
    kind = F.coalesce(F.col("geometry.type"), F.lit("None"))
    types = layer.groupBy(kind.alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("geometry_types"))
    return types.select("row_count", F.array(*map(F.lit, layer.columns)).alias("columns"), F.lit(meta.crs).alias("crs"), F.lit(meta.source_path).alias("source_path"), "geometry_types")


def gallery(datasets: DataFrame) -> DataFrame:
    """datasets(name, checks, issue_count) -> one row: datasets, checks (distinct), issues."""
    totals = datasets.agg(F.count(F.lit(1)).alias("datasets"), F.coalesce(F.sum("issue_count"), F.lit(0)).alias("issues"))
    checks = datasets.select(F.explode("checks").alias("c")).agg(F.count_distinct("c").alias("checks"))
    return totals.crossJoin(F.broadcast(checks))  # one row each


def catalog_errors(catalog: DataFrame, required: tuple[str, ...] = ("problem_name", "category", "severity")) -> DataFrame:
    """(problem_name, error) of a catalog: missing required fields, unknown categories and severities, repeated names."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    tests = [(blank(c), f"no {c}") for c in required] + [(~blank("category") & ~F.col("category").isin(*CATEGORIES), "unknown category"), (~blank("severity") & ~F.col("severity").isin(*SEVERITIES), "unknown severity")]
    single = catalog.select("problem_name", F.explode(F.filter(F.array(*[F.when(t, F.lit(e)) for t, e in tests]), lambda e: e.isNotNull())).alias("error"))
    twice = catalog.where(~blank("problem_name")).groupBy("problem_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("problem_name", F.lit("repeated name").alias("error"))
    return single.unionByName(twice)


def default_layer(inventory: DataFrame, term: str = "") -> DataFrame:
    """inventory(layer_name, n_features) -> its best layer: with features, then with most, then with the term in its name, then by name."""
    return inventory.orderBy(F.desc(F.col("n_features") > 0), F.desc("n_features"), F.desc(F.lower("layer_name").contains(term.lower())), "layer_name").limit(1)


def frames_of(layer: DataFrame) -> DataFrame:
    """(feature_pos, center_x, center_y, width, height, is_point) of each shape with coordinates."""
    b = G.bounds(F.col("geometry"))
    shapes = layer.where("geometry is not null and size(geometry.parts) > 0").select("feature_pos", *[c.alias(n) for n, c in b.items()])
    width, height = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return shapes.select("feature_pos", ((F.col("minx") + F.col("maxx")) / 2).alias("center_x"), ((F.col("miny") + F.col("maxy")) / 2).alias("center_y"), width.alias("width"), height.alias("height"), ((width == 0) & (height == 0)).alias("is_point"))


def sanitised(layer: DataFrame) -> DataFrame:
    """Shapes without coordinates, or with any that is not finite, become null."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    coords = G.coords(F.col("geometry"))
    return layer.withColumn("geometry", F.when((F.size(coords) > 0) & F.forall(coords, lambda c: finite(c["x"]) & finite(c["y"])), F.col("geometry")))


def dataset_type(columns: list[str]) -> str:
    lower = {c.lower() for c in columns}
    return next((kind for kind, own in DATASET_COLUMNS.items() if lower & set(own)), "generic")


@dataclass(frozen=True)
class DistrictHints:
    name_field: str | None
    created_field: str | None
    admin_field: str | None
    is_district_layer: bool


def district_hints(layer: DataFrame, meta: layers.LayerMeta) -> DistrictHints:
    """The columns that name a district, its date and its office, and whether the layer is one of districts: its first shape is a polygon and "dma" stands in a name."""

    def pick(names: tuple[str, ...], patterns: tuple[str, ...]) -> str | None:
        own = {c.lower(): c for c in layer.columns}
        return next((own[n] for n in names if n in own), None) or next((c for c in layer.columns if any(re.search(p, c.lower()) for p in patterns)), None)

    name = pick(DMA_NAMES, ("dma", r"\bname\b"))
    first = layer.where("geometry is not null and size(geometry.parts) > 0").select("geometry.type").limit(1).collect()
    told = "dma" in meta.source_path.lower() or any("dma" in c.lower() for c in layer.columns)
    return DistrictHints(name, pick(DMA_CREATED, ("created", "date", "time")), pick(DMA_ADMIN, ("admin", "office", "district", "region", "govern")), bool(first) and first[0][0] in G.POLYGONS and told)


def fix_crs(layer: DataFrame, meta: layers.LayerMeta, wanted: str) -> tuple[DataFrame, layers.LayerMeta]:
    """The layer in the wanted reference system; the same objects if it is in it. Without a readable one it is an error."""
    source, target = layers.epsg_code(meta.crs), layers.epsg_code(wanted)
    if source is None or target is None:
        raise ValueError(f"cannot transform from {meta.crs} to {wanted}")
    if source == target:
        return layer, meta
    return layer.withColumn("geometry", projections.transformed(F.col("geometry"), source, target)), replace(meta, crs=f"EPSG:{target}")


def crs_validation(layer: DataFrame, meta: layers.LayerMeta, expected: str = "EPSG:4326", fix: bool = False) -> tuple[DataFrame, DataFrame, layers.LayerMeta]:
    """(raw issues, layer, meta): missing and unexpected reference systems, and the layer transformed if asked for and possible."""
    spark = layer.sparkSession
    found = layers.missing_crs(spark, meta).unionByName(layers.invalid_crs(spark, meta, expected))
    return (found, *fix_crs(layer, meta, expected)) if fix and layers.epsg_code(meta.crs) is not None else (found, layer, meta)
